"""Toxicity by a linear classifier that is indifferent to which group a sentence names.

Features are the distinct words of the whole text, without case, and their beginnings of 4
to 6 letters.  Spark counts them over a bounded sample of labelled rows (some ``SAMPLE`` of
each label, those of the least hash of the id) and keeps those whose log-likelihood ratio
between the labels is at least ``SURE``.  Weights come from logistic regression in numpy.

*Counterfactuals.*  In each sampled text that names a group, the identity term is swapped for
every other term of its list, and the squared difference of the scores before and after is
part of the loss, so no weight can rest on the group that is named.  Identity terms stand
for a sentence each as well, without any label, so terms the sample never has are tied too.

Of a swap only the features that change are kept.

A null or empty text scores like a text without any feature.  A document with more than one
label counts as toxic if any says so; null labels are ignored.  Without rows of both labels
every score is 0.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, steps, written

SAMPLE, SURE = 6000, 6.63  # by chance one feature in a hundred is as sure
RIDGE, PENALTY, ROUNDS, SEED = 2e-4, 1.0, 300, 11
PREFIXES = (4, 5, 6)
#: Words whose features a worker remembers, and their length; when as many are known the memory is emptied.
MEMORY_WORDS, MEMORY_LENGTH = 200_000, 64
#: Terms that name a group; within a list each can stand for any other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("mexican", "american", "chinese", "german", "french", "russian", "indian", "turkish", "polish"),
    ("old", "young", "elderly", "teenage"), ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden"), ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos"),
)
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def scorer(self):
        of = {f: i for i, f in enumerate(self.features)}
        memory: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if len(memory) > MEMORY_WORDS:
                memory.clear()
            found: set[int] = set()
            for w in words_of(text):
                ids = memory.get(w)
                if ids is None:
                    ids = tuple(of[f] for f in features_of(w) if f in of)
                    if len(w) <= MEMORY_LENGTH:
                        memory[w] = ids
                if ids:
                    found.update(ids)
            z = self.bias + float(self.weights[list(found)].sum())
            return 1 / (1 + np.exp(-z)) if z > -700 else 0.0

        return score


def swaps(x: set[int], own: dict[str, set[int]], term_features: dict[str, set[int]]) -> list[tuple[list[int], list[int]]]:
    """Features that come and that go when one identity term of a text is swapped, for each such term and each other of its list.

    ``x`` has the text's features, ``own`` for each of its terms those that no other word has.
    """
    return [(sorted(term_features[o] - (x - own[t])), sorted(own[t] - term_features[o])) for terms in IDENTITIES for t in terms if t in own for o in terms if o != t]


def train(flat: np.ndarray, offset: np.ndarray, toxic: np.ndarray, changes: list[tuple[int, list[int], list[int]]], width: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows at once: mean log loss of each label, ridge, and the mean squared score change over counterfactual swaps.

    Row i has the features ``flat[offset[i]:offset[i + 1]]``; ``toxic`` is 1, 0 or -1 for a row without a label.
    A change is a row, the features that come and those that go.
    """
    n = len(toxic)
    row = np.repeat(np.arange(n), np.diff(offset))
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), np.where(toxic == 0, 0.5 / max(1, (toxic == 0).sum()), 0.0))
    of = np.array([c[0] for c in changes], np.int64)
    sign = np.concatenate([np.r_[np.ones(len(c[1])), -np.ones(len(c[2]))] for c in changes]) if changes else np.zeros(0)
    moved = np.fromiter((f for c in changes for part in c[1:] for f in part), np.int64)
    at = np.repeat(np.arange(len(changes)), [len(c[1]) + len(c[2]) for c in changes])
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, w[flat], n) + w[-1]
        error = (sigmoid(z) - toxic) * share
        g = RIDGE * w
        g[-1] = 0.0
        if changes:
            before, after = sigmoid(z[of]), sigmoid(z[of] + np.bincount(at, sign * w[moved], len(changes)))
            change = 2 * PENALTY * (before - after) / len(changes)
            slope = change * after * (1 - after)
            error += np.bincount(of, change * before * (1 - before) - slope, n)
            g += np.bincount(moved, -sign * slope[at], width + 1)
        g += np.bincount(flat, error[row], width + 1)
        g[-1] = error.sum()
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, train_on: Callable[[Column], Column], id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """The classifier, learned from rows of ``docs`` for whose id ``train_on`` holds."""
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("__of")).agg((F.max(label_column) > 0).cast("int").alias("__toxic"))
    known = known.where(train_on(F.col("__of")))
    counts = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    if len(counts) < 2:
        return Model()
    chance = F.pmod(F.xxhash64(F.col("__of").cast("string"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(chance < F.when(F.col("__toxic") == 1, min(1.0, SAMPLE / counts[1])).otherwise(min(1.0, SAMPLE / counts[0])))
    # The shares keep the sample at 2 * SAMPLE rows; the limit proves the bound of what is broadcast.
    known = F.broadcast(known.limit(3 * SAMPLE))
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")).join(known, F.col("__id") == F.col("__of")).select("__id", "__text", "__toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array([sorted(words_of(t)) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], ["id", "toxic", "words"])

    texts = written(batched(rows).mapInArrow(words, "id string, toxic int, words array<string>"), "sample")
    total = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model()
    beginnings = F.flatten(F.array(F.array("w"), *(F.when(F.length("w") > n, F.array(F.concat(F.substring("w", 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in PREFIXES)))
    by_feature = (
        texts.select("id", "toxic", F.explode("words").alias("w")).select("id", "toxic", F.explode(beginnings).alias("f")).distinct()
        .groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    )
    # Dunning's log-likelihood ratio of a feature's counts against equal shares in both labels.
    n = F.col("bad") + F.col("fine")
    told = lambda seen, of: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) * (total[0] + total[1]) / (n * of))).otherwise(0.0)
    g = 2 * (told("bad", total[1]) + told("fine", total[0]) + sum(F.when(of > F.col(seen), (of - F.col(seen)) * F.log((of - F.col(seen)) * F.lit(float(total[0] + total[1])) / ((total[0] + total[1] - n) * of))).otherwise(0.0) for seen, of in (("bad", total[1]), ("fine", total[0]))))
    chosen = [r["f"] for r in by_feature.where(g >= SURE).select("f").collect()]  # of a bounded sample
    features = sorted({*chosen, *(f for terms in IDENTITIES for t in terms for f in features_of(t))})
    of = {f: i for i, f in enumerate(features)}
    numbers = lambda w: {of[f] for f in features_of(w) if f in of}
    names = {t: numbers(t) for terms in IDENTITIES for t in terms}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of each text as 4 bytes each, its identity terms, and for each of them how many of its features no other word has, and which."""
        for batch in batches:
            out = []
            for i, y, ws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                times = Counter(f for w in ws for f in numbers(w))
                out.append((i, y, np.array(sorted(times), np.int32).tobytes(), [t for t in ws if t in names], [sorted(f for f in names[t] if times[f] == 1) for t in ws if t in names]))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["id", "toxic", "x", "terms", "own"])

    encoded = sorted(texts.mapInArrow(encode, "id string, toxic int, x binary, terms array<string>, own array<array<int>>").collect(), key=lambda r: (r["id"] or "", r["toxic"], bytes(r["x"])))
    rows = [np.frombuffer(r["x"], np.int32) for r in encoded]
    changes = [(i, *s) for i, r in enumerate(encoded) if r["terms"] for s in swaps(set(rows[i].tolist()), dict(zip(r["terms"], map(set, r["own"]), strict=True)), names)]
    # Each term as a text of its own, without a label.
    alone = sorted(names)
    changes += [(len(rows) + i, *s) for i, t in enumerate(alone) for s in swaps(names[t], {t: names[t]}, names)]
    rows += [np.array(sorted(names[t]), np.int32) for t in alone]
    toxic = np.array([r["toxic"] for r in encoded] + [-1] * len(alone))
    weights, bias = train(np.concatenate(rows).astype(np.int64), np.cumsum([0, *map(len, rows)]), toxic, changes, len(features))
    return Model(features, weights, bias)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``score``, ``predicted`` (1 from 0.5)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for part in steps(batch, 1):
                s = [score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [id_column, "score", "predicted"])

    return batched(docs.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")

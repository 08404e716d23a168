"""Language identification by a byte convolutional network, trained in numpy.

Bytes are folded into 64 classes (letters without case, UTF-8 lead and continuation bytes,
digits, space, the rest).  Filters of widths 2, 3 and 4 slide over windows of fixed length;
the maximum of each filter over a window goes through a rectifier and a linear layer, whose
outputs are averaged over all windows of the whole text and turned into shares by a softmax.

Training takes a bounded sample of the windows of all labelled texts, wherever in a text they
lie: at most some ``SAMPLE`` for each label, less where labels are so many that it would be
more than ``ALL_SAMPLES`` together, those of the least hash of id and place.  Every label is
learned.  Only the text and the label are seen; the caller says by ``train_on`` which rows
may be learned from.

A null text or one without a letter is ``und`` with score 0; with no labelled rows every
text is.  Any other text gets a learned label, however short.  Texts shorter than a window are
padded.  Rows that repeat are each predicted; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, steps, texts_of

WINDOW, FILTERS, WIDTHS, CLASSES = 256, 16, (2, 3, 4), 64
SAMPLE, ALL_SAMPLES = 2000, 120_000
#: Passes over the sample, more where they would be fewer than ``LEAST_STEPS`` steps.
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 10, 1000, 64, 0.01, 7
UNDETERMINED = "und"


def byte_classes() -> np.ndarray:
    """Class of each byte: letters 1-26 without case, white space 0, digits 27, other ASCII 28, lead bytes 29-31, continuation bytes 32-63 (those of capital and small Latin-1 letters alike)."""
    c = np.full(256, 28, np.uint8)
    c[[32, *range(9, 14)]] = 0
    c[48:58] = 27
    c[65:91] = c[97:123] = np.arange(1, 27)
    c[128:192] = 32 + np.arange(64) % 32
    c[192:196], c[196:224], c[224:] = 29, 30, 31
    return c


TABLE = byte_classes()


def windows_of(text: bytes) -> np.ndarray:
    """Classes of a text in windows, the last one padded."""
    c = TABLE[np.frombuffer(text, np.uint8)]
    n = max(1, -(-len(c) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(c)] = c
    return out.reshape(n, WINDOW)


def has_letter(text: bytes) -> bool:
    if text.lower() != text.upper():  # ASCII letters
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class Network:
    labels: list[str]
    filters: dict[int, np.ndarray]  # of each width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the filters add for two classes in a row: places 0 and 1 of every width, places 2 and 3 of width 4; for one class: place 2 of width 3."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS)
        return np.concatenate([two(self.filters[w][0], self.filters[w][1]) for w in WIDTHS], axis=1), two(self.filters[4][2], self.filters[4][3]), self.filters[3][2]

    def pooled(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The maximum of each filter over each window, rectified."""
        first, second, single = tables
        pair = windows[:, :-1].astype(np.int32) * CLASSES + windows[:, 1:]
        found = np.take(first, pair, axis=0)
        two, three, four = (found[:, : WINDOW - w + 1, k * FILTERS : (k + 1) * FILTERS] for k, w in enumerate(WIDTHS))
        three = three + np.take(single, windows[:, 2:], axis=0)
        four = four + np.take(second, pair[:, 2:], axis=0)
        return np.maximum(0, np.concatenate([x.max(axis=1) for x in (two, three, four)], axis=1) + self.bias)

    def logits(self, windows: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.tables()
        return np.concatenate([self.pooled(windows[i : i + 32], tables) for i in range(0, len(windows), 32)]) @ self.out + self.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, labels: list[str]) -> Network:
    """Adam on the cross-entropy of windows; gradients go only through the places of the maxima."""
    rng = np.random.default_rng(SEED)
    net = Network(labels, {w: (rng.normal(size=(w, CLASSES, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), (rng.normal(size=(FILTERS * len(WIDTHS), len(labels))) * 0.1).astype(np.float32), np.zeros(len(labels), np.float32))
    weights = [*net.filters.values(), net.bias, net.out, net.out_bias]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(windows))) if len(windows) else 0):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            x, y = windows[order[start : start + BATCH]], label[order[start : start + BATCH]]
            places, values = [], []
            for w in WIDTHS:
                conv = sum(net.filters[w][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                places.append(conv.argmax(axis=1))
                values.append(np.take_along_axis(conv, places[-1][:, None], axis=1)[:, 0])
            before = np.concatenate(values, axis=1) + net.bias
            hidden = np.maximum(0, before)
            error = softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.out.T) * (before > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[w])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at = np.take_along_axis(x, places[k] + j, axis=1)
                    np.add.at(g[j], (at, np.broadcast_to(np.arange(FILTERS), at.shape)), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for w, g, m, s in zip(weights, grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def sample_windows(docs: DataFrame, train_on: Column, id_column: str, text_column: str, label_column: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of the windows of labelled rows, their labels by number, and all labels."""
    rows = docs.where(train_on & F.col(label_column).isNotNull()).select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"), F.col(label_column).cast("string").alias("__label"))
    rows = rows.withColumn("__n", F.ceil(F.octet_length("__text") / WINDOW).cast("int"))
    counts = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.sum("__n").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    if len(labels) > ALL_SAMPLES:
        raise ValueError(f"more than {ALL_SAMPLES} labels")
    each = min(SAMPLE, ALL_SAMPLES // len(labels))
    shares = docs.sparkSession.createDataFrame([(i, c, min(1.0, each / max(1, counts[c]))) for i, c in enumerate(labels)], "__of int, __name string, __share double")
    chance = lambda k: F.pmod(F.xxhash64(F.col("__id").cast("string"), k, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: chance(k) < F.col("__share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                out = [windows_of(t)[at].tobytes() for t, at in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), part.column(2)], ["windows", "label"])

    rows = rows.where("__n > 0").join(F.broadcast(shares), F.col("__label") == F.col("__name")).select("__text", chosen.alias("__at"), "__of").where(F.size("__at") > 0)
    found = batched(rows).mapInArrow(run, "windows binary, label int").collect()
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in found]
    return np.concatenate([np.zeros((0, WINDOW), np.uint8), *x]), np.repeat(np.array([r["label"] for r in found], np.int64), [len(w) for w in x]), labels


def fit(docs: DataFrame, train_on: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Network | None:
    x, y, labels = sample_windows(docs, train_on, id_column, text_column, label_column)
    if not labels:
        return None
    order = np.lexsort((np.ascontiguousarray(x).view(f"S{WINDOW}").ravel(), y))  # the same whatever order the rows came in
    return train(x[order], y[order], labels)


def predict(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (the share of that label)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net and net.tables()
        for batch in batches:
            for part in steps(batch, 1):
                label, score = [], []
                texts = part.column(1).cast(pa.binary()).to_pylist()
                known = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
                cut = [windows_of(texts[i]) for i in known]
                label, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if cut:
                    z = net.logits(np.concatenate(cut), tables)
                    ends = np.cumsum([0, *map(len, cut)])
                    mean = np.add.reduceat(z, ends[:-1], axis=0) / np.diff(ends)[:, None]
                    p = softmax(mean.astype(np.float64))
                    for i, row in zip(known, p, strict=True):
                        k = int(row.argmax())
                        label[i], score[i] = net.labels[k], float(row[k])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(score, pa.float64())], [id_column, "lang_pred", "score"])

    return batched(docs.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")

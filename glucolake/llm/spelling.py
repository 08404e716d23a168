"""Spelling variants by the full neighbourhood of every word.

Words that differ by one deleted, replaced or inserted code point are found without comparing
words: each word emits all its distinct neighbours over the alphabet observed in the
vocabulary, and a neighbour that is a word itself is near.  As every neighbour is at distance
one by the way it is made, no distance is verified.

Neighbours are emitted as polynomial hashes, a numpy array for each kind of edit and many
words at a time.  Nearly all of them are no words; they are left out by a filter that has the
hashes of the vocabulary (at most ``FILTER_BITS`` bits, whatever the vocabulary), before
anything is shuffled.  What passes is spelt out and hash-joined to the vocabulary by its text,
so a hash that many share costs a row but never a wrong answer, and a vocabulary too large for
the filter only makes it pass more.

A form is a near word at least ``RATIO`` times as frequent, so frequencies rise along forms,
and roots are found by pointer doubling in as many rounds as the longest chain has digits in
base two.

A null text has no words; a null id counts as empty text in ``garbled``; equal ids and repeated
rows count as they come; ties go to the least word in code-point order; an empty table gives an
empty result.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, steps, written

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: The filter has up to so many bits for each word, and never more in all (32 MB); a piece of it is a row while it is built.
BITS_A_WORD, FILTER_BITS, PIECE_BITS = 16, 1 << 28, 1 << 16
#: Distinct words that a task counts before it hands them on.
FLUSH = 500_000
#: Neighbours that are hashed at a time.
STEP = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def garbled(doc_id: object, run: str, every: int = 199) -> str:
    """``run`` without one code point, where ``every`` divides the CRC-32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """``word`` and its occurrences ``n`` in all whole texts, of words of ``least_length`` code points that occur ``least_count`` times.

    Words are counted in each task first.  ``change`` alters a document's run before it is counted; it may shorten it.
    """
    runs = re.compile(RUN + "{%d,}" % least_length)  # shorter runs can't become words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in steps(batch, 1):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for run, n in Counter(runs.findall((text or "").translate(_UPPER))).items():
                        word = change(i, run) if change else run
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= FLUSH:
                        yield out()
        if held:
            yield out()

    counted = batched(docs.select(id_column, text_column)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, modulo 2^64."""
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of code points: their sum, each times BASE to the power of its place."""
    return (codes.astype(np.uint64) * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Hashes of the neighbours of words of one length: kind of edit, and an array by word, place and (but for deletions) letter of the alphabet.

    What would be the word itself, or the same as an earlier edit, is not told apart here.
    """
    n = codes.shape[1]
    c, power = codes.astype(np.uint64), _powers(n + 1)
    here = c * power[:n]
    nothing = np.zeros((len(c), 1), np.uint64)
    before = np.concatenate([nothing, np.cumsum(here, axis=1, dtype=np.uint64)], axis=1)  # of the places before i
    up = c * power[1 : n + 1]
    after_up = np.concatenate([np.cumsum(up[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], nothing], axis=1)  # from place i on, one place up
    down = c[:, 1:] * power[: n - 1]
    after_down = np.concatenate([np.cumsum(down[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], nothing], axis=1)  # from place i + 1 on, one place down: power i for c[i + 1]
    letters = alphabet.astype(np.uint64)
    yield "delete", before[:, :n] + after_down
    yield "replace", (before[:, n:] - here)[:, :, None] + power[:n, None] * letters
    yield "insert", (before[:, : n + 1] + after_up)[:, :, None] + power[: n + 1, None] * letters


class Filter:
    """Which hashes may be those of a word: two bits a hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def place(self, h: np.ndarray, again: bool) -> np.ndarray:
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        if again:
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (mixed >> self.shift).astype(np.int64)

    def _has(self, h: np.ndarray, again: bool) -> np.ndarray:
        at = self.place(h, again)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def may_have(self, h: np.ndarray) -> np.ndarray:
        """Flat places in ``h`` of those that may be words."""
        h = h.ravel()
        found = np.flatnonzero(self._has(h, False))
        return found[self._has(h[found], True)]


def vocabulary_filter(words: DataFrame) -> Filter:
    """The filter of all words, built in pieces by the tasks; what comes to the driver is the filter itself."""
    total = words.count()
    bits = max(PIECE_BITS, min(FILTER_BITS, 1 << (BITS_A_WORD * max(total, 1) - 1).bit_length()))
    empty = Filter(bits)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(bits)
        for batch in batches:
            for codes, _ in by_length(batch.column(0).to_pylist()):
                for again in (False, True):
                    at = empty.place(hashes(codes), again)
                    np.bitwise_or.at(held.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = held.data.reshape(-1, PIECE_BITS // 8)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["at", "bits"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(data, np.uint8)
                held[at] = held[at] | data if at in held else data
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["at", "bits"])

    schema = "at int, bits binary"
    out = Filter(bits)
    for row in words.select("word").mapInArrow(pieces, schema).repartition("at").mapInArrow(together, schema).toLocalIterator():
        start = row["at"] * PIECE_BITS // 8
        out.data[start : start + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def by_length(words: list[str], most: int | None = None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length together (``most`` of them at a time), as code points and as they are."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for start in range(0, len(group), most or len(group)):
            part = group[start : start + (most or len(group))]
            yield _codes(part), part


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``: all pairs of words of a written table that differ by one edit, both ways round."""
    spark = words.sparkSession
    # The alphabet is bounded by the code points that words are made of.
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint32)
    held = spark.sparkContext.broadcast(vocabulary_filter(words))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters = held.value, [chr(c) for c in alphabet]
        for batch in batches:
            for group in by_length(batch.column(0).to_pylist()):
                length = group[0].shape[1]
                for codes, few in by_length(group[1], max(1, STEP // max(1, (length + 1) * len(alphabet)))):
                    found: set[tuple[str, str]] = set()
                    for kind, h in neighbours(codes, alphabet):
                        for place in zip(*(x.tolist() for x in np.unravel_index(known.may_have(h), h.shape)), strict=True):
                            w, i = few[place[0]], place[1]
                            near = w[:i] + w[i + 1 :] if kind == "delete" else w[:i] + letters[place[2]] + w[i + (kind == "replace") :]
                            if near != w:
                                found.add((w, near))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["word", "near"])

    candidates = words.select("word").mapInArrow(emit, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("__word")), F.col("near") == F.col("__word"), "left_semi")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of ``words`` (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = written(words.select("word", "n"), "words")
    other = words.select(F.col("word").alias("__near"), F.col("n").alias("__n"))
    pairs = near_words(words).join(other, F.col("near") == F.col("__near"))
    best = pairs.groupBy(F.col("word").alias("__word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("__n")).alias("minus"), "near")).alias("__best"))
    best = best.select("__word", "n_near", F.col("__best.near").alias("__form"), (-F.col("__best.minus")).alias("__form_n"))
    rows = words.join(best, F.col("word") == F.col("__word"), "left")
    good = F.col("__form_n") >= ratio * F.col("n")
    rows = written(rows.select("word", F.when(good, F.col("__form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("__form_n")).alias("form_n")), "forms")
    roots = chain_ends(rows.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("end")))
    rows = rows.join(roots, F.col("word") == F.col("node"), "left")
    return rows.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def chain_ends(links: DataFrame) -> DataFrame:
    """``node`` and the ``end`` of its chain, from links ``node`` to ``end`` (one a node, without circles)."""
    while True:
        links = written(links, "chains")
        ahead = links.select(F.col("node").alias("__at"), F.col("end").alias("__end"))
        if not links.join(ahead, F.col("end") == F.col("__at"), "left_semi").limit(1).count():
            return links
        links = links.join(ahead, F.col("end") == F.col("__at"), "left").select("node", F.coalesce("__end", "end").alias("end"))

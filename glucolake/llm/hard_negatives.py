"""Hard negatives by a vector-approximation file.

Every dimension is cut into up to ``CELLS`` cells at quantiles of a bounded sample, the outermost
cells reaching to the least and largest value of all rows, and a vector is kept as one byte a
dimension.  A search reads these cells alone: tables give the lower and upper edge of each cell,
and an anchor's score with any vector of these cells lies between the sum of the lesser products
and the sum of the greater ones.  Only vectors whose bounds say that they may be among the first
``k`` in a window of scores are scored exactly, from the vectors themselves.

Anchors and vectors meet in blocks.  Both are cut into blocks sized from their counts; a pair of
blocks is streamed through one task, anchors first, which keeps for each anchor and window the
``k`` largest lower bounds of vectors surely in the window, and the candidates whose upper bound
reaches them.  The same is then done over all blocks, and what is left is joined to the vectors
and scored.  Positives are a search among rows of the anchor's label in the window of all scores;
negatives one among rows of other labels with a window for each positive.

Of rows with the same vector and label only the ``k + 1`` of least ids can be among the first k
of any anchor (one of them may be the anchor itself), so the others are left out of the search,
not of the anchors: first in each task, then over tasks, so a vector that a third of all rows
have is no group of rows.

Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part.
Vectors of unequal length are as if followed by zeros.  Repeated ids are rows of their own: ties
in score and id go by place in the table.  A component beyond ``LARGEST`` after scaling is refused
(``ValueError``).  An empty table, or one without anchors, gives an empty result.  Columns other
than the three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, partitions, written

#: Cells of a dimension; rows of the sample that the cells' edges come from.
CELLS, SAMPLE = 256, 20_000
#: Largest size of a scaled component: products of 2048 of them stay exact.
LARGEST = 1 << 26
#: Anchors and vectors of a pair of blocks at most; vectors of a row; anchors and vectors whose bounds are worked out at a time.
ANCHORS, VECTORS, ROW, STEP = 32_768, 1 << 20, 4096, 512
#: A pair of blocks has at least so many vectors, however many tasks there are.
LEAST_VECTORS = 1024
#: Candidates of a task before those below the latest bounds are let go.
HELD = 2_000_000


def _matrix(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is whole and finite, and their components, scaled and floored, as a matrix with zeros after shorter ones."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.cast(flat, pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    present = np.maximum(lengths, 0)
    starts = np.cumsum(present) - present
    good = lengths >= 0
    bad = np.flatnonzero(~np.isfinite(values))
    if len(bad):
        good[np.repeat(np.arange(len(lengths)), present)[bad]] = False
    rows = np.flatnonzero(good)
    out = np.zeros((len(rows), int(lengths[rows].max()) if len(rows) else 0))
    for n in np.unique(lengths[rows]):
        at = np.flatnonzero(lengths[rows] == n)
        out[at, :n] = values[starts[rows[at]][:, None] + np.arange(n)]
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return rows, out.astype(np.int32)


def prepare(vectors: DataFrame, id_column: str, vector_column: str, label: Column, scale: float) -> DataFrame:
    """A written table of the rows that take part: ``key`` (place in the table), ``id``, ``label``, ``vec`` (32-bit components)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).alias("v")).where("id is not null and label is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            good, matrix = _matrix(batch.column(2), scale)
            keys = nth + np.arange(len(good))
            nth += len(good)
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), batch.column(1).take(at), pa.array([r.tobytes() for r in matrix], pa.binary())], ["key", "id", "label", "vec"])

    return written(batched(rows).mapInArrow(run, "key long, id long, label long, vec binary"), "vectors")


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector and label the ``k + 1`` of least id (and place)."""

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > 50_000:
                held = [least(held)]
        if held:
            yield least(held)

    def least(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order = np.lexsort((table.column("key").to_numpy(), table.column("id").to_numpy()))
        seen: dict[tuple[bytes, int], int] = {}
        vec, label, keep = table.column("vec").to_pylist(), table.column("label").to_pylist(), []
        for i in order.tolist():
            n = seen[vec[i], label[i]] = seen.get((vec[i], label[i]), 0) + 1
            if n <= k + 1:
                keep.append(i)
        return table.take(pa.array(sorted(keep), pa.int64())).combine_chunks().to_batches()[0] if keep else held[0].slice(0, 0)

    local = rows.mapInArrow(fewer, rows.schema)
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("vec", "label"), "vec", "label").orderBy("id", "key"))
    return local.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")


class Cells:
    """Edges of the cells of each dimension, by which vectors become bytes."""

    def __init__(self, rows: DataFrame, width: int):
        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full(width, LARGEST), np.full(width, -LARGEST)
            for batch in batches:
                if batch.num_rows:
                    m = vectors_of(batch.column(0), width)
                    low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["d", "low", "high"])

        found = {r["d"]: r for r in rows.select("vec").mapInArrow(extremes, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        low, high = (np.array([found[d][c] for d in range(width)], np.int64) for c in ("low", "high"))
        sample = np.sort(vectors_of(pa.array([r[0] for r in rows.orderBy(F.xxhash64("key")).select("vec").limit(SAMPLE).collect()], pa.binary()), width), axis=0)
        #: The least value of each cell, rising, and the greatest.  Cells that no value of the sample tells apart are empty.
        first = sample[(np.arange(CELLS) * len(sample)) // CELLS].astype(np.int64)
        first[0] = low
        self.low = np.maximum.accumulate(np.maximum(first, low), axis=0).T.copy()
        self.high = np.maximum(np.c_[self.low[:, 1:] - 1, high], self.low)

    def codes(self, matrix: np.ndarray) -> np.ndarray:
        out = np.empty(matrix.shape, np.uint8)
        for d in range(matrix.shape[1]):
            out[:, d] = np.searchsorted(self.low[d], matrix[:, d], side="right") - 1
        return out

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Lower edges of all dimensions, then upper edges, looked up for each code."""
        d = np.arange(codes.shape[1])
        return np.concatenate([self.low[d, codes], self.high[d, codes]], axis=1)


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of 32-bit components, zeros after shorter ones."""
    blobs = column.to_pylist()
    if all(len(b) == 4 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), width)
    return np.frombuffer(b"".join(b.ljust(4 * width, b"\0") for b in blobs), np.int32).reshape(len(blobs), width)


def by_block(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each number in ``column``, ``ROW`` at most at a time."""
    numbers = batch.column(column).to_numpy(zero_copy_only=False)
    order = np.argsort(numbers, kind="stable")
    starts = np.searchsorted(numbers[order], values := np.unique(numbers))
    for value, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        for at in range(a, b, ROW):
            yield value, batch.take(pa.array(order[at : min(b, at + ROW)]))


class Best:
    """For each anchor and window the ``k`` largest lower bounds of vectors surely in it, and the candidates, vector by vector as they come."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, matrix: np.ndarray, windows: np.ndarray, k: int, same: bool, exact: type):
        self.keys, self.labels, self.windows, self.k, self.same = keys, labels, windows, k, same
        plus, minus = np.maximum(matrix, 0), np.minimum(matrix, 0)
        self.under = np.concatenate([plus, minus], axis=1).astype(exact)
        self.over = np.concatenate([minus, plus], axis=1).astype(exact)
        n, w = windows.shape[:2]
        self.bounds = np.full((n * w, k), -np.inf)
        self.candidates: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, keys: np.ndarray, labels: np.ndarray, edges: np.ndarray) -> None:
        n_windows = self.windows.shape[1]
        for start in range(0, len(self.keys), STEP):
            rows = slice(start, start + STEP)
            least, most = self.under[rows] @ edges.T, self.over[rows] @ edges.T
            fits = (self.labels[rows, None] == labels) == self.same
            for w in range(n_windows):
                low, high = self.windows[rows, w, 0], self.windows[rows, w, 1]
                slot = np.arange(start, start + len(low)) * n_windows + w
                floor = np.maximum(low, self.bounds[slot, -1])
                a, v = np.nonzero(fits & (most >= floor[:, None]) & (least <= high[:, None]))
                if not len(a):
                    continue
                lower, upper = least[a, v].astype(float), most[a, v].astype(float)
                sure = (lower >= low[a]) & (upper <= high[a])
                self._raise(slot[a[sure]], lower[sure])
                stays = upper >= self.bounds[slot[a], -1]
                self.candidates.append((slot[a[stays]], keys[v[stays]], lower[stays], upper[stays], sure[stays]))
                self.n += int(stays.sum())
        if self.n > HELD:
            self.candidates = [self._left()]
            self.n = len(self.candidates[0][0])

    def _raise(self, slot: np.ndarray, lower: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.r_[slot, np.repeat(touched, self.k)]
        lower = np.r_[lower, self.bounds[touched].ravel()]
        order = np.lexsort((-lower, slot))
        starts = np.searchsorted(slot[order], touched)
        self.bounds[touched] = lower[order][starts[:, None] + np.arange(self.k)]

    def _left(self) -> tuple[np.ndarray, ...]:
        if not self.candidates:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float, bool))
        all_ = [np.concatenate(x) for x in zip(*self.candidates, strict=True)]
        stays = all_[3] >= self.bounds[all_[0], -1]
        return tuple(x[stays] for x in all_)

    def rows(self) -> pa.RecordBatch:
        slot, key, lower, upper, sure = self._left()
        w = self.windows.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.keys[slot // w]), pa.array((slot % w).astype(np.int32)), pa.array(key), pa.array(lower), pa.array(upper), pa.array(sure)], ["anchor", "window", "key", "lower", "upper", "sure"])


class Index:
    """The cells of all vectors in blocks, written to the shared folder, and the vectors themselves."""

    def __init__(self, rows: DataFrame, width: int):
        self.spark, self.width, self.rows = rows.sparkSession, width, rows
        self.cells = cells = Cells(rows, width)
        self.count = rows.count()
        self.blocks = max(1, -(-self.count // VECTORS), min(partitions(self.spark), self.count // LEAST_VECTORS))
        self.largest = float(np.maximum(np.abs(cells.low), np.abs(cells.high)).max()) if width else 0.0

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, part in by_block(batch, "block"):
                    keys, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label"))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, labels, cells.codes(vectors_of(part.column("vec"), width))))], ["block", "keys", "labels", "data"])

        dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int")).repartition(self.blocks, "block")
        self.packed = written(batched(dealt).mapInArrow(pack, "block int, keys binary, labels binary, data binary"), "cells")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` vectors in each window of each anchor: ``anchor``, ``window``, ``key``, ``id``, ``score``, ``rank``.

        ``anchors`` is a written table of ``key``, ``label``, ``vec`` and ``windows``: pairs of the least and largest score, one after the other, the same
        number in every row.  ``same``: only vectors of the anchor's label (and not the anchor), else only those of others.
        """
        cells, width, blocks = self.cells, self.width, self.blocks
        n_anchors = anchors.count()
        groups = max(1, -(-n_anchors // ANCHORS))
        # Whole numbers are exact as 32-bit floats up to 2^24, as 64-bit ones up to 2^53.
        exact = np.float32 if 2 * self.largest**2 * width < 1 << 24 else np.float64
        take = k + same

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, part in by_block(batch, "group"):
                    data = (*(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label")), vectors_of(part.column("vec"), width), part.column("windows").flatten().to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["group", "keys", "labels", "data", "windows"])

        few = anchors.select("key", "label", "vec", "windows", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group")).repartition(groups, "group")
        few = written(batched(few).mapInArrow(pack, "group int, keys binary, labels binary, data binary, windows binary"), "anchors")
        left = few.select("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "keys", "labels", "data", "windows")
        right = self.packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "block", F.lit(1).alias("kind"), "keys", "labels", "data", F.lit(None).cast("binary").alias("windows"))
        pairs = left.unionByName(right).repartition(max(1, min(groups * blocks, 100_000)), "group", "block").sortWithinPartitions("group", "block", "kind")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, best = None, [], None
            for batch in batches:
                for group, block, kind, keys, labels, data, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (group, block) != at:
                        if best:
                            yield best.rows()
                        at, held, best = (group, block), [], None
                    keys, labels = np.frombuffer(keys, np.int64), np.frombuffer(labels, np.int64)
                    if kind == 0:
                        held.append((keys, labels, np.frombuffer(data, np.int32).reshape(len(keys), width), np.frombuffer(windows, np.int64).reshape(len(keys), -1, 2)))
                    elif held or best:
                        if best is None:
                            best, held = Best(*(np.concatenate(x) for x in zip(*held, strict=True)), take, same, exact), []
                        best.add(keys, labels, cells.edges(np.frombuffer(data, np.uint8).reshape(len(keys), width)).astype(exact))
            if best:
                yield best.rows()

        found = batched(pairs).mapInArrow(scan, "anchor long, window int, key long, lower double, upper double, sure boolean")
        # The same bounds over all blocks.
        of = Window.partitionBy("anchor", "window")
        found = found.withColumn("nth", F.row_number().over(of.orderBy(F.desc("sure"), F.desc("lower"))))
        found = found.withColumn("floor", F.max(F.when(F.col("sure") & (F.col("nth") == take), F.col("lower"))).over(of))
        found = found.where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("anchor", "window", "key")
        pairs = found.groupBy("anchor", "key").agg(F.collect_list("window").alias("found_in"))  # a window once each
        pairs = pairs.join(self.rows.select(F.col("key").alias("__key"), "id", "vec"), F.col("key") == F.col("__key"))
        pairs = pairs.join(anchors.select(F.col("key").alias("__anchor"), F.col("vec").alias("__vec"), "windows"), F.col("anchor") == F.col("__anchor"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (vectors_of(batch.column(c), width).astype(np.int64) for c in ("vec", "__vec"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "key", "id", "found_in", "windows")), pa.array((a * b).sum(axis=1))], ["anchor", "key", "id", "found_in", "windows", "score"])

        scored = pairs.select("anchor", "key", "id", "found_in", "windows", "vec", "__vec").mapInArrow(score, "anchor long, key long, id long, found_in array<int>, windows array<long>, score long")
        scored = scored.select("anchor", "key", "id", "score", "windows", F.explode("found_in").alias("window"))
        inside = (F.col("score") >= F.get("windows", 2 * F.col("window"))) & (F.col("score") <= F.get("windows", 2 * F.col("window") + 1))
        if same:
            inside &= F.col("key") != F.col("anchor")
        rank = F.row_number().over(of.orderBy(F.desc("score"), "id", "key"))
        return scored.where(inside).select("anchor", "window", "key", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components are floor(scale * x), scores integer inner products.  An anchor (a row for which
    ``is_anchor``, of the column ``id``, holds) has as positives its first ``positives`` other rows of the same label by score and
    id.  For each, the first ``negatives`` rows of other labels are given whose score is from ``least_percent`` to
    ``most_percent`` hundredths of the positive's.  Both ends are inclusive and compared as whole numbers.
    """
    k = max(positives, negatives)
    rows = prepare(vectors, id_column, vector_column, F.col("label") if label is None else label, scale)
    width = (rows.agg(F.max(F.length("vec"))).first()[0] or 0) // 4
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.where(is_anchor)
    if not width or not anchors.limit(1).count():
        return rows.sparkSession.createDataFrame([], schema)
    index = Index(written(distinct_enough(rows, k), "distinct"), width)
    everything = F.array(F.lit(-(1 << 62)), F.lit(1 << 62))
    anchors = written(anchors.withColumn("windows", everything), "queries")
    near = written(index.search(anchors, positives, True), "positives")
    limits = near.groupBy(F.col("anchor").alias("__anchor")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))  # ``positives`` at most
    # 100 * negative from least * positive to most * positive; a window for each positive, empty ones (1, 0) after the last.
    window = lambda s: F.array(_floor_div(s * least_percent + 99, 100), _floor_div(s * most_percent, 100))
    windows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.when(i < F.size("found"), window(F.get("found", i)["score"])).otherwise(F.array(F.lit(1).cast("long"), F.lit(0).cast("long")))))
    asked = written(anchors.drop("windows").join(limits, F.col("key") == F.col("__anchor")).select("key", "label", "vec", windows.alias("windows")), "asked")
    hard = index.search(asked, negatives, False)
    of = anchors.select(F.col("key").alias("__key"), F.col("id").alias("anchor_id"))
    positive = near.select(F.col("anchor").alias("__of"), (F.col("rank") - 1).alias("__window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(positive, (F.col("anchor") == F.col("__of")) & (F.col("window") == F.col("__window"))).join(of, F.col("anchor") == F.col("__key"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(x: Column, by: int) -> Column:
    """Whole-number division, rounded down also below zero."""
    return F.floor(x.cast("decimal(30,0)") / F.lit(by)).cast("long")

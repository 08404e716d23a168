"""Random forests of many subjects, grown together level by level.

Each subject has a forest of its own, and all of them grow in one job a level.  Features are
binned at the subject's own quantiles; a subject's rows are dealt into chunks of some ``CHUNK``
rows, so one with a third of all rows is spread like any other.  In a level every chunk counts,
for its subject's trees and the nodes still open in them, rows and events by (node, candidate
feature, bin).  Counts are added up in rounds, ``FAN_IN`` chunks at a time, and the split that
lowers the Gini impurity most is chosen from the sums.  Nothing comes to the driver but whether
a node is open; a task holds one chunk, or the counts of a block of trees.

A tree draws its rows with Poisson(1) weights, fixed by the row's key and the tree, and a node its
``sqrt(features)`` candidates, fixed by tree and node: a lost task counts the same again, and the
forest doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.functions.tables import stored

#: Bins of a feature, levels below the root, rows up to which a node isn't split.
BINS, DEPTH, LEAST_NODE = 32, 8, 10
#: Rows of a chunk, trees of a block, chunks whose counts are added up at a time.
CHUNK, BLOCK, FAN_IN = 20_000, 50, 8
#: States of a node that has no split: nothing there, a leaf, still open.
ABSENT, LEAF, OPEN = -3, -1, -2
#: A node: splitting feature (or its state), the last bin that goes left, drawn rows and events.
NODE = np.dtype([("feature", "<i2"), ("bin", "<i2"), ("n", "<i8"), ("e", "<i8")])
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    salt = mix(np.array([tree + (seed << 20) + 1], np.uint64))
    u = (mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(_CDF, u, side="right")


def candidates(tree: int, nodes: np.ndarray, features: int, seed: int) -> np.ndarray:
    """The features that each node of a tree may be split by."""
    at = mix(nodes.astype(np.uint64) + np.uint64((tree << 32) + (seed << 24)))
    order = mix(at[:, None] + np.arange(features, dtype=np.uint64))
    return np.argsort(order, axis=1, kind="stable")[:, : max(1, math.isqrt(features))]


def impurity(n: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Gini impurity times rows."""
    return 2.0 * e * (n - e) / np.maximum(n, 1)


def best_splits(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """From counts by (node, candidate, bin, rows or events): candidate, last bin of the left side, decrease of impurity, rows and events of the left side and of the node.

    Ties go to the first candidate and bin.
    """
    left = counts.cumsum(axis=2)
    n, e = left[:, :, -1:, 0], left[:, :, -1:, 1]
    nl, el = left[..., 0], left[..., 1]
    gain = np.where((nl > 0) & (nl < n), impurity(n, e) - impurity(nl, el) - impurity(n - nl, e - el), -1.0)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    c, b = np.unravel_index(best, gain.shape[1:])
    rows = np.arange(len(gain))
    return c, b, gain[rows, c, b], nl[rows, c, b], el[rows, c, b], n[:, 0, 0], e[:, 0, 0]


def descend(tree: np.ndarray, codes: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row is in, ``levels`` below the root or where its path ends."""
    node = np.ones(len(codes), np.int64)
    rows = np.arange(len(codes))
    for _ in range(levels):
        feature = tree["feature"][node]
        split = feature >= 0
        if not split.any():
            break
        node = np.where(split, 2 * node + (codes[rows, np.maximum(feature, 0)] > tree["bin"][node]), node)
    return node


def _open(trees: np.ndarray, level: int) -> list[np.ndarray]:
    """Open nodes of each tree of a block."""
    return [np.flatnonzero(t["feature"][1 << level : 2 << level] == OPEN) + (1 << level) for t in trees]


def level_counts(trees: np.ndarray, first: int, level: int, keys: np.ndarray, codes: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Counts of a chunk's training rows for all open nodes of a block of trees, one after the other."""
    features = codes.shape[1]
    out = []
    for t, nodes in enumerate(_open(trees, level)):
        tried = candidates(first + t, nodes, features, seed)
        m = tried.shape[1] if len(nodes) else max(1, math.isqrt(features))
        held = np.zeros((len(nodes), m, BINS, 2), np.int64)
        if len(nodes) and len(codes):
            at = np.full(2 << level, -1)
            at[nodes] = np.arange(len(nodes))
            w = row_weights(keys, first + t, seed)
            a = at[descend(trees[t], codes, level)]
            use = np.flatnonzero((a >= 0) & (w > 0))
            a, w = a[use], w[use]
            for j in range(m):
                cell = (a * m + j) * BINS + codes[use, tried[a, j]]
                for k, weight in enumerate((w, w * y[use])):
                    held[..., k] += np.bincount(cell, weight, len(nodes) * m * BINS).reshape(len(nodes), m, BINS).astype(np.int64)
        out.append(held.ravel())
    return np.concatenate(out)


def grow_level(trees: np.ndarray, first: int, level: int, depth: int, counts: np.ndarray, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The block with its open nodes split, and the decrease of impurity by feature."""
    trees, gains = trees.copy(), np.zeros(features)
    m = max(1, math.isqrt(features))
    start = 0
    for t, nodes in enumerate(_open(trees, level)):
        size = len(nodes) * m * BINS * 2
        held = counts[start : start + size].reshape(len(nodes), m, BINS, 2)
        start += size
        if not len(nodes):
            continue
        tried = candidates(first + t, nodes, features, seed)
        c, b, gain, nl, el, n, e = best_splits(held)
        tree = trees[t]
        tree["n"][nodes], tree["e"][nodes] = n, e
        good = (gain > 1e-12) & (n > LEAST_NODE)
        tree["feature"][nodes[~good]] = LEAF
        feature = tried[np.arange(len(nodes)), c]
        tree["feature"][nodes[good]], tree["bin"][nodes[good]] = feature[good], b[good]
        for side, cn, ce in ((0, nl, el), (1, n - nl, e - el)):
            child = 2 * nodes[good] + side
            cn, ce = cn[good], ce[good]
            tree["n"][child], tree["e"][child] = cn, ce
            ends = (cn <= LEAST_NODE) | (ce == 0) | (ce == cn) | (level + 1 >= depth)
            tree["feature"][child] = np.where(ends, LEAF, OPEN)
        np.add.at(gains, feature[good], gain[good])
    return trees, gains


def probabilities(trees: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
    """The mean over trees of the share of events in the leaf that a row falls into."""
    total = np.zeros(len(codes))
    for tree in trees:
        leaf = descend(tree, codes, depth)
        total += tree["e"][leaf] / np.maximum(tree["n"][leaf], 1)
    return total / len(trees)


class Forests:
    """Forests of the subjects of ``rows``: ``scores`` and ``importance``.

    ``rows`` is a stored table of ``id``, ``key`` (a number of the row, once), ``target`` (0 or 1), ``train`` (boolean), ``total`` (the subject's
    rows) and ``features``, none of them null.  Every subject needs a training row.
    """

    def __init__(self, rows: DataFrame, features: list[str], trees: int = 200, depth: int = DEPTH, seed: int = 1):
        self.features, self.trees, self.depth, self.seed = features, trees, depth, seed
        cuts = [(i + 1) / BINS for i in range(BINS - 1)]
        train = rows.where("train").groupBy("id").agg(F.flatten(F.array(*(F.percentile_approx(f, cuts, 1000) for f in features))).alias("edges"), F.max(F.ceil(F.col("total") / CHUNK)).cast("int").alias("salts"))
        self.subjects = stored(train, "edges")
        self.salts = self.subjects.agg(F.max("salts")).first()[0] or 0
        self.chunks = self._chunks(rows)
        self.state = self._grow()

    def _dealt(self, per_subject: DataFrame) -> DataFrame:
        """Rows of each subject (or its blocks), once for each of its chunks."""
        salts = self.subjects.select(F.col("id").alias("__id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("__salt"))
        return per_subject.join(salts, F.col("id") == F.col("__id")).drop("id")

    def _chunks(self, rows: DataFrame) -> DataFrame:
        names = self.features
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("total") / CHUNK)).cast("int")).select("id", "salt", "key", "target", "train", *names)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.to_pandas()
                for (i, salt), part in d.groupby(["id", "salt"], sort=False):
                    blobs = [part["key"].to_numpy(np.int64), part["target"].to_numpy(np.int8), part["train"].to_numpy(bool), part[names].to_numpy(float)]
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([salt], pa.int32()), *(pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs)], ["id", "salt", "key", "y", "train", "x"])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x, edges in zip(batch.column("x").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    x, edges = np.frombuffer(x).reshape(-1, len(names)), np.array(edges).reshape(len(names), -1)
                    out.append(np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(len(names))]).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "salt", "key", "y", "train")), pa.array(out, pa.binary())], ["id", "salt", "key", "y", "train", "codes"])

        kept = "id string, salt int, key binary, y binary, train binary"
        packed = dealt.repartition("id", "salt").sortWithinPartitions("id", "salt").mapInArrow(pack, f"{kept}, x binary")
        edges = self._dealt(self.subjects.select("id", "edges"))
        packed = packed.join(edges, (F.col("id") == F.col("__id")) & (F.col("salt") == F.col("__salt"))).drop("__id", "__salt")
        return stored(packed.mapInArrow(code, f"{kept}, codes binary"), "chunks")

    def _grow(self) -> DataFrame:
        depth, seed, features, width = self.depth, self.seed, len(self.features), 2 << self.depth
        blocks = -(-self.trees // BLOCK)
        sizes = [min(BLOCK, self.trees - b * BLOCK) for b in range(blocks)]

        def seedlings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, n in enumerate(sizes):
                    trees = np.zeros((n, width), NODE)
                    trees["feature"] = ABSENT
                    trees["feature"][:, 1] = OPEN
                    same = batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([block] * same, pa.int32()), pa.array([trees.tobytes()] * same, pa.binary()), pa.array([np.zeros(features).tobytes()] * same, pa.binary())], ["id", "block", "trees", "gains"])

        state = stored(self.subjects.select("id").mapInArrow(seedlings, "id string, block int, trees binary, gains binary"), "forest")  # ``trees / BLOCK`` rows a subject

        def nodes_of(blob: bytes) -> np.ndarray:
            return np.frombuffer(blob, NODE).reshape(-1, width)

        for level in range(depth):

            def count(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i, salt, key, y, train, codes, block, trees, gains in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        own = np.frombuffer(train, bool)
                        rows = np.frombuffer(codes, np.uint8).reshape(len(own), features)
                        counts = level_counts(nodes_of(trees), block * BLOCK, level, np.frombuffer(key, np.int64)[own], rows[own], np.frombuffer(y, np.int8)[own], seed)
                        first = salt == 0
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([trees if first else None], pa.binary()), pa.array([gains if first else None], pa.binary())], ["id", "block", "salt", "counts", "trees", "gains"])

            def add(table: pa.Table) -> pa.Table:
                counts = None
                for chunk in table.column("counts").to_pylist():
                    one = np.frombuffer(chunk, np.int64)
                    counts = one if counts is None else counts + one
                given = [(t, g) for t, g in zip(table.column("trees").to_pylist(), table.column("gains").to_pylist(), strict=True) if t is not None]
                trees, gains = given[0] if given else (None, None)
                one = lambda x, kind: pa.array([x], kind)
                return pa.table({"id": one(table.column("id")[0].as_py(), pa.string()), "block": one(table.column("block")[0].as_py(), pa.int32()), "salt": one(table.column("up")[0].as_py(), pa.int32()), "counts": one(counts.tobytes(), pa.binary()), "trees": one(trees, pa.binary()), "gains": one(gains, pa.binary())})

            def split(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i, block, _, counts, trees, gains in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        grown, gained = grow_level(nodes_of(trees), block * BLOCK, level, depth, np.frombuffer(counts, np.int64), features, seed)
                        open_ = bool((grown["feature"] == OPEN).any())
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([block], pa.int32()), pa.array([grown.tobytes()], pa.binary()), pa.array([(np.frombuffer(gains) + gained).tobytes()], pa.binary()), pa.array([open_])], ["id", "block", "trees", "gains", "open"])

            schema = "id string, block int, salt int, counts binary, trees binary, gains binary"
            joined = self.chunks.join(self._dealt(state.select("id", "block", "trees", "gains")), (F.col("id") == F.col("__id")) & (F.col("salt") == F.col("__salt")))
            counted = joined.select("id", "salt", "key", "y", "train", "codes", "block", "trees", "gains").mapInArrow(count, schema)
            # A chunk that an Arrow batch has cut in two comes twice: rounds go on until one row is left of a block.
            left = max(1, self.salts)
            while True:
                counted = counted.withColumn("up", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("id", "block", "up").applyInArrow(add, schema)
                left = -(-left // FAN_IN)
                if left <= 1:
                    break
            state = stored(counted.mapInArrow(split, "id string, block int, trees binary, gains binary, open boolean"), "forest")
            if not state.where("open").limit(1).count():
                break
        return state

    def scores(self) -> DataFrame:
        """``key`` and ``probability`` of every row of subjects with a forest."""
        depth, features, width = self.depth, len(self.features), 2 << self.depth
        whole = self.state.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "trees"))).alias("blocks"))  # bounded by the number of trees

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, codes, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    keys = np.frombuffer(key, np.int64)
                    trees = np.frombuffer(b"".join(b["trees"] for b in blocks), NODE).reshape(-1, width)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(probabilities(trees, np.frombuffer(codes, np.uint8).reshape(len(keys), features), depth))], ["key", "probability"])

        joined = self.chunks.join(self._dealt(whole), (F.col("id") == F.col("__id")) & (F.col("salt") == F.col("__salt")))
        return joined.select("key", "codes", "blocks").mapInArrow(score, "key long, probability double")

    def importance(self) -> DataFrame:
        """``id``, ``feature``, ``importance``: the decrease of impurity by the splits at a feature, a tree on average."""
        names, trees = self.features, self.trees

        def add(table: pa.Table) -> pa.Table:
            blocks = sorted(zip(table.column("block").to_pylist(), table.column("gains").to_pylist(), strict=True))
            total = sum(np.frombuffer(g) for _, g in blocks) / trees
            return pa.table({"id": pa.array([table.column("id")[0].as_py()] * len(names), pa.string()), "feature": names, "importance": pa.array(total)})

        return self.state.select("id", "block", "gains").groupBy("id").applyInArrow(add, "id string, feature string, importance double")

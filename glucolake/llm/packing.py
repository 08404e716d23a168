"""Packing token sequences by linear grouping, then best fit.

A document's ids and an end id are one piece, or several of ``limit`` ids where they are more
(the first piece is the shorter one).  Lengths are whole numbers up to ``limit``, so what the
driver plans on are histograms of at most ``limit`` entries, whatever the number of documents:

1. Pieces longer than ``limit * LARGE``, longest first, fall into up to ``GROUPS`` groups of
   equal cardinality, and each group's lengths are rounded up to its longest.
2. The few sizes left make a cutting-stock problem, solved over configurations (how many of
   each size a sequence holds) by column generation; a knapsack over the sizes finds the next
   configuration.  Each configuration is used as often as its solution's whole part says.
3. Actual pieces take the slots of their group: a piece's rank in the group tells the slot, and
   so its sequence, by arithmetic.
4. What is left of the groups, and then the small pieces, go by best fit, longest first, into
   the room that actual lengths leave, and into new sequences where nothing fits.  Sequences of
   the same room are alike, so a step deals with a stretch of them at once.

Ranks are counted by partition and length and added up over partitions: no task orders all
pieces, and a length that a third of all pieces have is no group of rows.

A null or empty text is the end id alone.  Rows are packed one by one, whatever their ids: null
ids and repeated rows need no rule; ties are any.  An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucolake.llm.bpe import tokenizer
from glucolake.llm.shared import batched, steps, written

LIMIT, END = 2048, 0
#: Share of ``limit`` above which a piece is large; groups of large pieces.
LARGE, GROUPS = 1 / 8, 256
#: The linear programme ends this near its optimum (as a share), or after so many pivots; what it has by then is a solution.
NEAR, PIVOTS = 1e-3, 10_000


def _nth(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each value how many equal ones came before it; ``seen`` has the counts of earlier batches and is brought up to date."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(v)])
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - np.repeat(starts, sizes) + seen[v]
    seen[v[starts]] += sizes
    return out


def cut(docs: DataFrame, file: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: id, ``piece``, ``start``, ``length``, ``ids_crc32``, a key (``__part``, ``length``, ``__nth``) and, with ``keep_ids``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = tokenizer(file), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        last = np.uint32(end).astype("<u4").tobytes()
        for batch in batches:
            for few in steps(batch, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, coded in enumerate(bpe.encode(["" if t is None else t for t in few.column(1).to_pylist()])):
                    coded = memoryview(coded + last)
                    n = len(coded) // 4
                    bounds = [0, *range((n - 1) % limit + 1, n + 1, limit)]
                    for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        row.append(i)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(coded[4 * a : 4 * b]))
                        if keep_ids:
                            ids.append(np.frombuffer(coded[4 * a : 4 * b], "<u4").astype(np.int32))
                sizes = np.array(length, np.int64)
                out = {id_column: few.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64()), "__part": pa.array([part] * len(row), pa.int32()), "__nth": pa.array(_nth(sizes, seen))}
                if keep_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, __part int, __nth bigint" + ", ids array<int>" * keep_ids)


def ranked(rows: DataFrame, value: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` with ``__rank``, from 0 among those of the same ``value``, and how many there are of each value (at most ``limit`` of them).

    ``rows`` is a written table with ``__part`` and, counted within it for each value, ``__nth``.
    """
    per = rows.groupBy(value, "__part").agg(F.count("*").alias("__n"))
    per = written(per.withColumn("__base", F.sum("__n").over(Window.partitionBy(value).orderBy("__part")) - F.col("__n")), "ranks")  # a row per partition and value
    counts = {r[0]: r[1] for r in per.groupBy(value).agg(F.sum("__n")).collect()}
    per = per.select(F.col(value).alias("__value"), F.col("__part").alias("__in"), "__base")
    out = rows.join(per, (F.col(value) == F.col("__value")) & (F.col("__part") == F.col("__in"))).withColumn("__rank", F.col("__base") + F.col("__nth"))
    return out.drop("__value", "__in", "__base"), counts


def _good_configurations(sizes: np.ndarray, worth: np.ndarray, limit: int) -> list[np.ndarray]:
    """For each size the configuration with it that is worth most, the best first: an unbounded knapsack."""
    best, last = np.zeros(limit + 1), np.full(limit + 1, -1)
    for t in np.flatnonzero(worth > 0):
        s = sizes[t]
        for _ in range(limit // s):
            with_it = best[:-s] + worth[t]
            better = np.flatnonzero(with_it > best[s:] + 1e-12)
            if not len(better):
                break
            best[s + better] = with_it[better]
            last[s + better] = t
    out = []
    for t in np.argsort(-(worth + best[limit - sizes]), kind="stable"):
        config, room = np.zeros(len(sizes), np.int64), int(limit - sizes[t])
        config[t] = 1
        while room > 0 and last[room] >= 0:
            config[last[room]] += 1
            room -= int(sizes[last[room]])
        out.append(config)
    return out


def configurations(sizes: list[int], demand: list[int], limit: int = LIMIT) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used (fractions too), so that every size's demand is met by the fewest sequences: the cutting-stock programme by column generation."""
    s, k = np.array(sizes, np.int64), len(sizes)
    columns = np.diag(limit // s)
    inverse = np.diag(1 / (limit // s))
    # demands slightly apart: ties would let pivots go round in place
    use = np.array(demand, float) * (1 + 1e-5 * (np.arange(k) * 0.618034 % 1)) / (limit // s)
    others = ~np.eye(k, dtype=bool)
    pivots = 0
    while k and pivots < PIVOTS:
        entered = 0
        for config in _good_configurations(s, inverse.sum(axis=0), limit):
            if inverse.sum(axis=0) @ config <= 1 + NEAR:  # no gain left in it
                continue
            direction = inverse @ config
            ratio = np.full(k, np.inf)
            up = direction > 1e-9
            ratio[up] = use[up] / direction[up]
            out = int(ratio.argmin())
            columns[:, out] = config
            use = np.maximum(0, use - ratio[out] * direction)
            use[out] = ratio[out]
            inverse[out] /= direction[out]
            inverse[others[out]] -= np.outer(direction[others[out]], inverse[out])
            entered += 1
        if not entered:  # no solution has fewer sequences than this one over 1 + NEAR
            break
        pivots += entered
    return [(columns[:, i].copy(), float(use[i])) for i in range(k) if use[i] > 1e-9]


class Groups:
    """Where the pieces of a histogram of lengths go: a slot of a configuration, or on to best fit.

    Pieces shorter than ``limit`` are numbered longest first.  ``first[l]`` is the number of the
    first piece of length l.
    """

    def __init__(self, counts: dict[int, int], limit: int = LIMIT):
        n = np.zeros(limit + 2, np.int64)
        for length, c in counts.items():
            n[length] = c
        self.full = int(n[limit])
        n[limit] = 0
        self.first = n[::-1].cumsum()[::-1] - n
        total = int(n.sum())
        large = int(n[int(limit * LARGE) + 1 :].sum())
        size = -(-large // GROUPS) if large else 1
        starts, lengths = [], []
        for at in range(0, large, size):
            # the longest of a group is the length of its first piece
            longest = int(np.flatnonzero(n[: limit + 1] * (self.first[: limit + 1] <= at))[0])
            if not lengths or lengths[-1] != longest:
                starts.append(at)
                lengths.append(longest)
        self.starts = np.array([*starts, large], np.int64)
        demand = np.diff(self.starts)
        self.bins, slots, runs = 0, np.zeros(len(lengths), np.int64), [[] for _ in lengths]
        for config, use in configurations(lengths, demand.tolist(), limit):
            times = int(use + 1e-6)
            # no more slots than there are pieces
            times = min([times, *((demand[t] - slots[t]) // config[t] for t in np.flatnonzero(config))])
            if times > 0:
                for t in np.flatnonzero(config):
                    runs[t].append((int(slots[t]), times, self.bins))
                    slots[t] += times * config[t]
                self.bins += int(times)
        self.slots = slots
        #: Stretches of slots: number of the group's first piece in them, sequences, first sequence.
        self.runs = np.array([(self.starts[t] + a, times, b) for t, r in enumerate(runs) for a, times, b in r], np.int64).reshape(-1, 3)
        #: Stretches of pieces that go on to best fit, and how many did before each.
        rest = np.array([*((self.starts[t] + slots[t], self.starts[t + 1]) for t in range(len(lengths))), (large, total)], np.int64).reshape(-1, 2)
        self.rest = rest[rest[:, 1] > rest[:, 0]]
        self.rest_before = np.cumsum(np.r_[0, self.rest[:, 1] - self.rest[:, 0]])
        of = np.arange(limit)
        left = self._left(self.first[of] + n[of]) - self._left(self.first[of])
        self.left = {int(x): int(left[x]) for x in of[::-1] if left[x]}

    def _left(self, number: np.ndarray) -> np.ndarray:
        """How many pieces before this number go on to best fit."""
        if not len(self.rest):
            return np.zeros(len(number), np.int64)
        at = np.searchsorted(self.rest[:, 0], number, side="right") - 1
        inside = np.minimum(number, self.rest[at, 1]) - self.rest[at, 0]
        return np.where(at < 0, 0, self.rest_before[at] + inside)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each piece (-1: none yet), and its number among those of its length that go on to best fit."""
        number = self.first[length] + rank
        t = np.searchsorted(self.starts, number, side="right") - 1
        in_slot = np.zeros(len(number), bool)
        if len(self.slots):
            group = np.minimum(t, len(self.slots) - 1)
            in_slot = (t < len(self.slots)) & (number - self.starts[group] < self.slots[group])
        bins = np.full(len(number), -1, np.int64)
        if in_slot.any():
            run = self.runs[np.searchsorted(self.runs[:, 0], number[in_slot], side="right") - 1]
            bins[in_slot] = run[:, 2] + (number[in_slot] - run[:, 0]) % run[:, 1]
        return bins, np.where(in_slot, 0, self._left(number) - self._left(self.first[length]))


def best_fit(left: dict[int, int], rooms: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Best fit, longest first, of ``left`` (pieces of each length) into ``rooms`` (sequences of each room) and new sequences.

    Returns stretches (length, first piece, pieces a sequence, room at first, first sequence of that
    room), sorted, and the number of new sequences, whose room at first is ``limit``.
    """
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]
    some = bytearray(limit + 1)
    for room, n in rooms.items():
        if room > 0 and n > 0:
            held[room].append((room, 0, n))
            some[room] = 1
    out, new = [], 0

    def put(room: int, stretch: tuple[int, int, int]) -> None:
        if room:
            held[room].append(stretch)
            some[room] = 1

    for length in sorted(left, reverse=True):
        todo, first = left[length], 0
        while todo:
            room = some.find(1, length)
            if room < 0:
                need = -(-todo // (limit // length))
                put(limit, (limit, new, new + need))
                new += need
                continue
            origin, a, b = held[room].pop()
            some[room] = bool(held[room])
            each = room // length
            whole = min(b - a, todo // each)
            if whole:
                out.append((length, first, each, origin, a))
                put(room - each * length, (origin, a, a + whole))
                first, todo, a = first + whole * each, todo - whole * each, a + whole
            if todo and a < b:  # one more sequence takes what is left of this length
                out.append((length, first, todo, origin, a))
                put(room - todo * length, (origin, a, a + 1))
                todo, a = 0, a + 1
            if a < b:
                put(room, (origin, a, b))
    return np.array(sorted(out), np.int64).reshape(-1, 5), new


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``__part``, ``length`` and ``__nth`` of each piece with ``sequence_id`` and ``offset``, from a written table that has them (``cut``)."""
    rows, counts = ranked(pieces.select("__part", "length", "__nth"), "length")
    if not counts:
        return pieces.select("__part", "length", "__nth", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = Groups(counts, limit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            bins, rest = groups.place(np.where(length < limit, length, 0), rank)
            whole = length == limit
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__part", "length", "__nth")), pa.array(np.where(whole, rank - groups.full, bins)), pa.array(np.where(whole, -1, rest))], ["__part", "length", "__nth", "bin", "rest"])

    # Sequences: whole pieces have -full to -1, configurations 0 to bins - 1, new ones follow.
    placed = written(rows.mapInArrow(place, "__part int, length bigint, __nth bigint, bin bigint, rest bigint"), "placed")
    fills = placed.where((F.col("bin") >= 0) & (F.col("length") < limit)).groupBy("bin").agg((limit - F.sum("length")).alias("room"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            room = batch.column("room").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), batch.column("room"), pa.array([part] * len(room), pa.int32()), pa.array(_nth(room, seen))], ["bin", "room", "__part", "__nth"])

    bins, rooms = ranked(written(fills.mapInArrow(number, "bin bigint, room bigint, __part int, __nth bigint"), "rooms"), "room")
    plan, _ = best_fit(groups.left, rooms, limit)
    key = (plan[:, 0] << 44) + plan[:, 1]
    settled = groups.bins

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rest"))
            at = plan[np.searchsorted(key, (length << 44) + rest, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__part", "length", "__nth")), pa.array(at[:, 3]), pa.array(at[:, 4] + (rest - at[:, 1]) // at[:, 2])], ["__part", "length", "__nth", "in_room", "at"])

    open_ = (F.col("bin") < 0) & (F.col("length") < limit)
    fitted = placed.where(open_).mapInArrow(fit, "__part int, length bigint, __nth bigint, in_room bigint, at bigint")
    keys = ("__part", "length", "__nth")
    bins = bins.select("bin", F.col("room").alias("__room"), F.col("__rank").alias("__at"))
    into = fitted.where(F.col("in_room") < limit).join(bins, (F.col("in_room") == F.col("__room")) & (F.col("at") == F.col("__at"))).select(*keys, F.col("bin").alias("sequence_id"))
    fresh = fitted.where(F.col("in_room") == limit).select(*keys, (F.col("at") + settled).alias("sequence_id"))
    all_ = placed.where(~open_).select(*keys, F.col("bin").alias("sequence_id")).unionByName(into).unionByName(fresh)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__part", "__nth")  # at most ``limit`` rows
    return all_.select(*keys, (F.col("sequence_id") + groups.full).alias("sequence_id"), (F.sum("length").over(order) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, file: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids``.

    ``file`` must be readable at the same path on every executor.
    """
    pieces = written(cut(docs, file, id_column, text_column, limit, end, keep_ids), "pieces")
    keys = ("__part", "length", "__nth")
    where = pack(pieces, limit).select(*(F.col(c).alias(f"{c}_") for c in keys), "sequence_id", "offset")
    same = [F.col(c) == F.col(f"{c}_") for c in keys]
    return pieces.join(where, same).drop("__part", "__nth", *(f"{c}_" for c in keys))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, in order, from ``pack_documents`` with ``keep_ids``; a sequence has at most ``limit`` of them."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

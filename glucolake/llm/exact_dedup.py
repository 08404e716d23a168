"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition sorts the SHA-256 digests of its normalised texts (A-Z lower-cased)
into a run and folds equal ones.  A run is cut into slices of the digest range.  In
binomial rounds the runs of a slice meet, ``FAN_IN`` at a time, in a multiway merge that
keeps for each digest the identifier that stays, the number of copies and the text's
length, which must agree at every level.  After ``log(partitions)`` rounds each slice has
one run; the groups of two or more rows found there are joined back to the first runs,
where a digest appears once a partition, so a hot text never gathers in one task.

Which row stays: ``keep="largest"`` or ``"smallest"`` identifier.  Null texts count as empty;
identifiers are whole numbers (``TypeError`` otherwise), null ones rank as the smallest; of
repeated rows with the same identifier one stays.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from glucolake.llm.shared import batched, partitions, steps, texts_of, written

FAN_IN = 8
#: Texts of a slice of the digest range: its last run is one value of some 60 bytes a text.
SLICE_TEXTS = 4_000_000
NULL_ID = np.iinfo(np.int64).min
#: What a run has for each digest: the digest, the identifier that stays, its partition, copies, text length.
RECORD = np.dtype([("digest", "S32"), ("keep", "<i8"), ("node", "<i4"), ("copies", "<i8"), ("length", "<i8")])


def _blob(records: np.ndarray) -> bytes:
    return records.tobytes()


def _merge(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Multiway merge of sorted runs; equal digests fold into one record."""
    rows = np.concatenate(runs)
    rows = rows[np.argsort(rows["digest"], kind="stable")]  # sorted stretches are merged, not sorted anew
    if not len(rows):
        return rows
    starts = np.flatnonzero(np.r_[True, rows["digest"][1:] != rows["digest"][:-1]])
    if len(starts) == len(rows):
        return rows
    group = np.cumsum(np.r_[False, rows["digest"][1:] != rows["digest"][:-1]])
    if (rows["length"] != rows["length"][starts][group]).any():
        raise ValueError("texts of different length have the same digest")
    # ~x turns the order around without overflow, also for NULL_ID
    best = np.lexsort((rows["node"], ~rows["keep"] if largest else rows["keep"], group))[starts]
    out = rows[best]
    out["copies"] = np.add.reduceat(rows["copies"], starts)
    return out


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", fan_in: int = FAN_IN, row_column: str | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text); and ``row_column``, a key of the rows, where it is given."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if not isinstance(docs.schema[id_column].dataType, IntegralType):
        raise TypeError(f"ids are whole numbers, {id_column} is {docs.schema[id_column].dataType.simpleString()}")
    largest, spark = keep == "largest", docs.sparkSession
    slices = max(8, partitions(spark), -(-docs.count() // SLICE_TEXTS))

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, lengths, own = [], [], [], []
        for batch in batches:
            ids.append(pc.fill_null(batch.column(0), int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64))
            if row_column:
                own.append(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            for part in steps(batch, 1):
                texts = texts_of(part.column(1))
                digests.append(b"".join(hashlib.sha256(t.lower()).digest() for t in texts))
                lengths.extend(map(len, texts))
        if not lengths:
            return
        rows = np.zeros(len(lengths), RECORD)
        rows["digest"] = np.frombuffer(b"".join(digests), "S32")
        rows["keep"], rows["node"], rows["copies"], rows["length"] = np.concatenate(ids), TaskContext.get().partitionId(), 1, lengths
        order = np.lexsort((~rows["keep"] if largest else rows["keep"], rows["digest"]))
        rows, own = rows[order], np.concatenate(own)[order] if row_column else np.zeros(0, np.int64)
        head = np.frombuffer(rows["digest"].tobytes(), ">u4").reshape(-1, 8)[:, 0].astype(np.uint64)
        bounds = np.searchsorted((head * np.uint64(slices)) >> np.uint64(32), np.arange(slices + 1))
        found = [(s, rows[a:b]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in found], pa.int32()), pa.array([int(rows["node"][0])] * len(found), pa.int32()), pa.array([_blob(r) for _, r in found], pa.binary()), pa.array([own[bounds[s] : bounds[s + 1]].tobytes() for s, _ in found], pa.binary()), pa.array([_blob(_merge([r], largest)) for _, r in found], pa.binary())],
            ["slice", "node", "members", "own", "run"],
        )

    runs = written(batched(docs.select(F.col(id_column).cast("long"), text_column, *([F.col(row_column).cast("long").alias("__own")] if row_column else []))).mapInArrow(first_runs, "slice int, node int, members binary, own binary, run binary"), "runs")

    def merge_round(table: pa.Table) -> pa.Table:
        merged = _merge([np.frombuffer(b, RECORD) for b in table.column("run").to_pylist()], largest)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "node": pa.array([table.column("up")[0].as_py()], pa.int32()), "run": pa.array([_blob(merged)], pa.binary())})

    level, left = runs.select("slice", "node", "run"), (runs.agg(F.max("node")).first()[0] or 0) + 1
    while left > 1:
        level = level.withColumn("up", F.floor(F.col("node") / fan_in).cast("int")).groupBy("slice", "up").applyInArrow(merge_round, "slice int, node int, run binary")
        left = -(-left // fan_in)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                r = np.frombuffer(blob, RECORD)
                r = r[r["copies"] > 1]
                if len(r):
                    digests = r["digest"].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()), pa.array(r["keep"]), pa.array(r["node"]), pa.array(r["copies"])], ["digest", "keep", "keep_node", "copies"])

    found = written(level.select("run").mapInArrow(groups, "digest binary, keep long, keep_node int, copies long"), "groups")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each digest of a first run, its identifiers (and its rows' keys) as lists in the order in which they would stay."""
        for batch in batches:
            for node, blob, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = np.frombuffer(blob, RECORD)
                starts = np.flatnonzero(np.r_[True, r["digest"][1:] != r["digest"][:-1]])
                digests = r["digest"][starts].tobytes()
                offsets = pa.array(np.r_[starts, len(r)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.ascontiguousarray(r["keep"]), *([np.frombuffer(own, np.int64)] if row_column else []))]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()), pa.array([node] * len(starts), pa.int32()), *lists], ["digest", "node", "ids", *owns])

    owns = ["owns"] if row_column else []
    lists = runs.select("node", "members", "own").mapInArrow(members, ", ".join(["digest binary, node int, ids array<bigint>", *(f"{c} array<bigint>" for c in owns)]))
    joined = lists.join(found, "digest", "left").select("digest", "node", "keep", "keep_node", "copies", *owns, F.posexplode("ids").alias("pos", "id"))
    null = lambda c: F.when(c != F.lit(int(NULL_ID)), c)
    kind = docs.schema[id_column].dataType
    return joined.select(
        null(F.col("id")).cast(kind).alias(id_column),
        null(F.coalesce("keep", "id")).cast(kind).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (F.col("copies").isNull() | ((F.col("node") == F.col("keep_node")) & (F.col("pos") == 0))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(F.get(c, F.col("pos")).cast(docs.schema[row_column].dataType).alias(row_column) for c in owns),
    )


def keep_rows(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id has a row in ``decisions`` with ``kept`` true; all columns stay.

    Rows that share an id share the decision.
    """
    kept = decisions.where("kept").select(F.col(id_column).alias("__kept_id"))
    return docs.join(kept, docs[id_column].eqNullSafe(kept["__kept_id"]), "left_semi")

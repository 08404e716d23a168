"""Sharding into near equal bytes by Karmarkar-Karp differencing over indivisible groups.

Equal texts form a group that stays in one shard.  A group above 1 / (shards * FINE) of all
bytes is an item of its own, of which there can be ``shards * FINE`` at most; the smaller
groups are dealt by hash into ``BUNDLES`` items.  So the differencing works on a bounded
number of items whatever the table's size: it holds partial partitions, each a tuple of
``shards`` sums, and repeatedly combines the two of the largest spread, the largest sum of
one with the smallest of the other, until a single partition is left.

Rows get gapless slots in their shard from the counts of ``SUBS`` parts of each shard, so
no task holds more than such a part.

Null texts count as empty.  Repeated rows are equal texts; among rows with equal ids and
texts slots are interchangeable.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucolake.llm.shared import written

FINE, BUNDLES, SUBS, ROW_BYTES = 256, 8192, 1024, 16


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, by the largest differencing method for ``shards`` parts."""
    if not sizes:
        return []
    # Items joined so far are kept as trees: (left, right, how right's parts fall on left's).
    sums = {i: np.concatenate([np.zeros(shards - 1, np.int64), [s]]) for i, s in enumerate(sizes)}
    parts: dict[int, tuple] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        # Place k of the new partition holds a's place order[k] and b's place shards - 1 - order[k].
        parts[fresh] = (a, b, order.astype(np.int32))
        both = both[order] - both[order[0]]
        sums[fresh] = both
        heapq.heappush(heap, (-int(both[-1]), fresh))
        fresh += 1
    shard = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(shards, dtype=np.int32))]
    while todo:
        x, place = todo.pop()  # place[k]: the shard of x's part k
        if x < len(sizes):
            shard[x] = int(place[-1])
            continue
        a, b, order = parts.pop(x)
        of_a = np.empty(shards, np.int32)
        of_a[order] = place
        todo += [(a, of_a), (b, of_a[::-1])]
    return shard


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    d = docs.select(F.col(id_column).alias("__id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("__group"))
    d = written(d.withColumn("__bundle", F.pmod(F.xxhash64("__group"), F.lit(BUNDLES)).cast("int")), "sizes")
    limit = (d.agg(F.sum("size")).first()[0] or 0) / (shards * FINE)
    large = d.groupBy("__group", "__bundle").agg(F.sum("size").alias("size")).where(F.col("size") > limit).collect()  # at most shards * FINE rows
    loose = {r["__bundle"]: r["size"] for r in d.groupBy("__bundle").agg(F.sum("size").alias("size")).collect()}
    for r in large:
        loose[r["__bundle"]] -= r["size"]
    items = sorted([(r["size"], bytes(r["__group"]), -1) for r in large] + [(s, b"", b) for b, s in loose.items() if s], key=lambda x: (-x[0], x[1], x[2]))
    of = karmarkar_karp([s for s, _, _ in items], shards)
    own = spark.createDataFrame([(bytearray(g), s) for (_, g, b), s in zip(items, of, strict=True) if b < 0], "__group binary, __own int")
    rest = spark.createDataFrame([(b, s) for (_, _, b), s in zip(items, of, strict=True) if b >= 0], "__bundle int, __rest int")
    # Both tables have a bounded number of rows: shards * FINE and BUNDLES.
    d = d.join(F.broadcast(own), "__group", "left").join(F.broadcast(rest), "__bundle", "left").withColumn("shard", F.coalesce("__own", "__rest"))
    d = d.withColumn("__sub", F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(SUBS)).cast("int")).select("__id", "size", "text_crc32", "shard", "__sub")
    counts = d.groupBy("shard", "__sub").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__sub")) - F.col("count")).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "__sub").orderBy(F.col("__id").asc_nulls_first(), "text_crc32", "size"))
    d = d.withColumn("__nth", slot).join(F.broadcast(before), ["shard", "__sub"])  # shards * SUBS rows at most
    return d.select(F.col("__id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Connected components of a link table, by local forests and pointer jumping.

Every task first joins the links it happens to hold into a forest whose nodes point at the
least node of their tree, so that a node of many links is left with one row a task.  A round
then has two steps.  Rows are dealt by node, and each task does the same again.  Then pointers
jump: where a node's target points further, so does the node.  Rounds go on until every node
has one target and no target points further.  All steps write their result to the shared
folder, and none gathers the links of a node: it gathers a row for each task at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.llm.shared import partitions, written

#: Nodes of a task's forest: the first step hands on what it has by then, later ones have partitions enough.
NODES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch], most: float = float("inf")) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def forest() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array([root(x) for x in nodes], np.int64))], ["node", "root"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= most:
            yield forest()
            parent.clear()
    if parent:
        yield forest()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node reachable) for every node that isn't its own root.

    ``links`` has two long columns, without nulls; their names and order don't matter.  An empty table gives an
    empty result.
    """
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root")
    most = NODES
    e = written(e.mapInArrow(lambda batches: _forest(batches, most), "node long, root long"), "forest")
    tasks = max(partitions(links.sparkSession), -(-e.count() // NODES))
    while True:
        e = written(e.repartition(tasks, "node").mapInArrow(_forest, "node long, root long"), "forest")
        # One target of each node is enough to jump to: its other targets are rows of their own.
        up = e.groupBy(F.col("node").alias("at")).agg(F.min("root").alias("further"))
        far = e.join(up, e["root"] == up["at"], "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        n = e.agg(F.count("*"), F.count_distinct("node")).first()
        moved = e.join(up.select("at"), e["root"] == up["at"], "left_semi").limit(1).count()
        if not moved and n[0] == n[1]:
            return e
        e = far.where("node <> root").select("node", "root")

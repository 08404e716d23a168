"""Fewer points for drawing: largest triangle three buckets, even thinning, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucolake.functions.columns import micros
from glucolake.functions.tables import stored

BUDGET, LEAST_PER_SUBJECT = 25_000, 250
#: Rows of a bucket up to which a task hands them on as they are.
FEW = 16


def per_subject_budget(subjects: int, budget: int = BUDGET, least: int = LEAST_PER_SUBJECT) -> int:
    return max(least, budget // max(1, subjects))


def lttb_indices(x: np.ndarray, y: np.ndarray, n_out: int) -> np.ndarray:
    """Indices of the points kept: both ends, and of each bucket the point that spans the largest triangle with the one kept before and the mean of the next bucket."""
    n = len(x)
    if n == 0 or n_out <= 0:
        return np.zeros(0, int)
    if n <= 2 or n_out >= n:
        return np.arange(n)
    if n_out <= 2:
        return np.array([0, n - 1])
    edges = np.floor(np.arange(n_out - 1) * ((n - 2) / (n_out - 2))).astype(int) + 1
    kept = [0]
    for i in range(n_out - 2):
        a, b, c = edges[i], min(edges[i + 1], n - 1), min(edges[i + 2] if i + 2 < len(edges) else n, n)
        mx, my = (x[b:c].mean(), y[b:c].mean()) if c > b else (x[-1], y[-1])
        px, py = x[kept[-1]], y[kept[-1]]
        area = np.abs((px - mx) * (y[a:b] - py) - (px - x[a:b]) * (my - py)) / 2
        kept.append(a + int(area.argmax()) if b > a else a)
    return np.array([*kept, n - 1])


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points in order of ``x``; of equal points the first."""
    order = np.lexsort((y, x))  # stable: of equal points the first comes first
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]].tolist() if len(x) else []
    if len(order) <= 2:
        return np.sort(np.array(order, int))
    x, y = x.tolist(), y.tolist()
    corners: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for k in way:
            while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[k] - y[chain[-2]]) <= (y[chain[-1]] - y[chain[-2]]) * (x[k] - x[chain[-2]]):
                chain.pop()
            chain.append(k)
        corners.update(chain)
    return np.sort(np.array(list(corners), int))


def lttb(df: DataFrame, n_out: int = LEAST_PER_SUBJECT) -> DataFrame:
    """Readings to draw, about ``n_out`` per subject; imputed ones and each subject's least and greatest value stay too.

    The size of a triangle over two given points is linear in the third, so the point of a bucket
    that spans the largest one is a corner of the bucket's convex hull.  Tasks keep the corners of
    their own rows of a bucket, these are put together by bucket, and only they and the buckets' means, a few
    rows for each of ``n_out`` points, are walked through in order: one pass over series of any length.
    """
    d = df.where(F.col("timestamp").isNotNull() & F.col("glucose").isNotNull())
    imputed = F.coalesce(F.col("imputed_flag"), F.lit(False)) if "imputed_flag" in df.columns else F.lit(False)
    s = stored(numbered_rows(d.withColumn("__imputed", imputed)).select("id", "timestamp", "glucose", "__imputed", "i", "n", micros().alias("us")), "series")
    ends = s.groupBy("id").agg(F.min("us").alias("start"), F.min_by("i", F.struct("glucose", "i")).alias("low"), F.min_by("i", F.struct(-F.col("glucose"), F.col("i"))).alias("high"))
    s = s.join(ends.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).withColumn("x", (F.col("us") - F.col("start")).cast("double"))
    keep = F.col("__imputed") | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | (F.col("i") == F.col("low")) | (F.col("i") == F.col("high"))
    columns = ("id", "timestamp", "glucose", F.col("__imputed").alias("imputed_flag"))
    long_ = (F.col("n") > n_out) & (F.col("n") > 2)
    if n_out <= 2:
        return s.where(keep | ~long_).select(*columns)
    # Bucket k has the rows from edge(k) to before edge(k + 1); the first and the last row are buckets of their own.
    edge = lambda k: F.floor(k * ((F.col("n") - 2) / F.lit(float(n_out - 2)))) + 1
    near = F.floor((F.col("i") - 1) * F.lit(n_out - 2) / (F.col("n") - 2))
    bucket = F.when(F.col("i") == 0, -1).when(F.col("i") == F.col("n") - 1, n_out - 2).when(edge(near + 1) <= F.col("i"), near + 1).when(edge(near) <= F.col("i"), near).otherwise(near - 1)
    rows = s.where(long_).select("id", bucket.cast("int").alias("bucket"), "i", "x", "glucose")
    means = rows.groupBy("id", "bucket").agg(F.avg("x").alias("x"), F.avg("glucose").alias("glucose"))
    kind = "id string, bucket int, i long, x double, glucose double"

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that are corners among the rows of their subject and bucket in the batch."""
        for batch in batches:
            who = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            k, i, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            order = np.lexsort((i, k, who))
            starts = np.flatnonzero(np.r_[True, (np.diff(k[order]) != 0) | (np.diff(who[order]) != 0)]) if len(order) else []
            kept = [part if len(part) <= FEW else part[hull(x[part], y[part])] for part in np.split(order, starts[1:])]
            yield batch.take(pa.array(np.concatenate(kept)))

    points = rows.mapInArrow(corners, kind).repartition("id", "bucket").sortWithinPartitions("id", "bucket").mapInArrow(corners, kind)
    every = points.withColumn("mean", F.lit(False)).unionByName(means.select("id", "bucket", F.lit(-1).cast("long").alias("i"), "x", "glucose", F.lit(True).alias("mean")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = {k: (x, y) for k, x, y in pdf.loc[pdf["mean"], ["bucket", "x", "glucose"]].itertuples(index=False)}
        places = pdf[~pdf["mean"]].sort_values(["bucket", "i"])
        number, i, x, y = (places[c].to_numpy() for c in ("bucket", "i", "x", "glucose"))
        starts = np.searchsorted(number, np.arange(n_out))
        px, py = mean[-1]
        kept = []
        for k in range(n_out - 2):
            part, (mx, my) = slice(starts[k], starts[k + 1]), mean[k + 1]
            best = starts[k] + int(np.abs((px - mx) * (y[part] - py) - (px - x[part]) * (my - py)).argmax())
            kept.append(int(i[best]))
            px, py = x[best], y[best]
        return pd.DataFrame({"__of": pdf["id"].iloc[0], "__kept": kept}).astype({"__of": object})

    chosen = every.groupBy("id").applyInPandas(walk, "__of string, __kept long")
    s = s.join(chosen, (F.col("id") == F.col("__of")) & (F.col("i") == F.col("__kept")), "left")
    return s.where(keep | ~long_ | F.col("__kept").isNotNull()).select(*columns)


def numbered_rows(df: DataFrame) -> DataFrame:
    """Rows with their place ``i`` in the subject's series and its length ``n``, by day and row within the day."""
    d = df.withColumn("__day", F.to_date("timestamp"))
    days = d.groupBy("id", "__day").agg(F.count("*").alias("c"))
    days = days.select("id", "__day", (F.sum("c").over(Window.partitionBy("id").orderBy("__day")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("id")).alias("n"))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("id", "__day").orderBy("timestamp", "_ord")) - 1)
    return d.join(days, ["id", "__day"]).withColumn("i", F.col("before") + F.col("nth")).drop("__day", "before", "nth")


def thin_evenly(df: DataFrame, n_out: int) -> DataFrame:
    """About ``n_out`` readings per subject at even places, the first and the last among them."""
    s = numbered_rows(df.where(F.col("timestamp").isNotNull()))
    step = F.floor(F.col("i") * (n_out - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    nxt = F.floor((F.col("i") - 1) * (n_out - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return s.where((F.col("n") <= n_out) | (F.col("i") == 0) | (step > nxt)).drop("i", "n")

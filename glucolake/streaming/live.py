"""Readings as a stream (beyond what batch analyses need): daily metrics, gaps, turning points.

All take a streaming (or batch) DataFrame with ``id``, ``timestamp``, ``glucose``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.config import Thresholds


def daily_time_in_range(stream: DataFrame, thresholds: Thresholds = Thresholds(), late: str = "6 hours") -> DataFrame:
    """Readings, mean and time in range by subject and day; a day is final once ``late`` has passed after it."""
    g = F.col("glucose")
    d = stream.withWatermark("timestamp", late).groupBy("id", F.window("timestamp", "1 day").alias("w"))
    return d.agg(F.count(g).alias("readings"), F.avg(g).alias("mean_glucose"), (100 * F.count_if(g.between(thresholds.tir_lower, thresholds.tir_upper)) / F.nullif(F.count(g), F.lit(0))).alias("tir_percent")).select("id", F.col("w.start").alias("day"), "readings", "mean_glucose", "tir_percent")


def wear_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    """Stretches without a gap: start, end and readings."""
    d = stream.withWatermark("timestamp", late).groupBy("id", F.session_window("timestamp", gap).alias("w"))
    return d.agg(F.count("*").alias("readings")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "readings")


def turning_points(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Local extremes of each subject's series as they become known: a reading above (or below) both neighbours.

    The state of a subject is its last two readings; readings older than these are ignored.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for ts, g in pd.concat(list(batches)).dropna(subset=["glucose"]).sort_values("timestamp")[["timestamp", "glucose"]].itertuples(index=False):
            if last and ts <= last[-1][0]:
                continue
            if len(last) == 2:
                a, b = last[0][1], last[1][1]
                if (b >= a and b > g) or (b <= a and b < g):
                    out.append((key[0], last[1][0], b, "peak" if b > g else "nadir"))
            last = [*last[-1:], (ts, float(g))]
        if last:
            state.update(tuple(map(list, zip(*last, strict=True))))
        yield pd.DataFrame(out, columns=["id", "timestamp", "glucose", "kind"])

    return (
        stream.withWatermark("timestamp", late).groupBy("id")
        .applyInPandasWithState(step, "id string, timestamp timestamp, glucose double, kind string", "ts array<timestamp>, g array<double>", "append", "NoTimeout")
    )

"""Complexity of glucose series: Shannon entropy, DFA, Higuchi dimension, Hurst exponent, multiscale entropy.

Series are numbered without a task per subject (counts by day, then by row within a day), so
that segments, lags and profiles are groupings by (subject, scale, segment).  Sample entropy compares
all pairs of points of series thinned to ``thin_to`` points, or, where that is None, counts pairs of
whole series over cells of the width of the tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import ComplexityParams
from glucolake.functions.columns import finite, real_subject
from glucolake.functions.tables import stored
from glucolake.operators.missingness import GAP
from glucolake.operators.quality import intervals, median_interval


def numbered(df: DataFrame) -> DataFrame:
    """``id``, ``i`` (from 0 in time order), ``x``, ``n`` (readings of the subject), without nulls."""
    d = df.withColumn("x", finite("glucose")).where(real_subject() & F.col("timestamp").isNotNull() & F.col("x").isNotNull()).select("id", "timestamp", "_ord", "x", F.to_date("timestamp").alias("day"))
    days = d.groupBy("id", "day").agg(F.count("*").alias("in_day"))
    by = Window.partitionBy("id").orderBy("day")
    days = days.withColumns({"before": F.sum("in_day").over(by) - F.col("in_day"), "n": F.sum("in_day").over(Window.partitionBy("id"))}).drop("in_day")
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("id", "day").orderBy("timestamp", "_ord")) - 1)
    return d.join(days, ["id", "day"]).select("id", (F.col("before") + F.col("nth")).alias("i"), "x", "n", "day")


#: How a series came about, and what is told of it.
SERIES_NOTES = {
    "observed": "Using observed finite glucose readings in timestamp order; no interpolation or gap filling was applied.",
    "imputed_regular": "Using imputed/generated analysis rows; no additional Complexity regularization was applied.",
}
POINTS = {"observed": "usable observed points", "imputed_regular": "usable imputed/regular analysis points"}
TIME_BASES = {"observed": "Observed readings in time order", "imputed_regular": "Imputed or generated rows in time order"}


def by_mode(texts: dict[str, str]):
    return F.when(F.col("series_mode") == "imputed_regular", texts["imputed_regular"]).otherwise(texts["observed"])


def series_modes(df: DataFrame) -> DataFrame:
    """``id`` and ``series_mode`` of each subject: ``imputed_regular`` if any of its rows was imputed or made for a gap, else ``observed``."""
    made = F.lit(False)
    for name in ("imputed_flag", "inserted_timestamp_gap"):
        if name in df.columns:
            made |= F.coalesce(F.col(name), F.lit(False))
    if "missing_source" in df.columns:
        made |= F.coalesce(F.col("missing_source") == GAP, F.lit(False))
    return df.where(real_subject()).groupBy("id").agg(F.when(F.bool_or(made), "imputed_regular").otherwise("observed").alias("series_mode"))


def series_summary(df: DataFrame, params: ComplexityParams = ComplexityParams(), gap_factor: float = 1.5) -> DataFrame:
    """What each subject's series is like before anything is computed from it: mode, rows, usable points, median interval, gaps longer than ``gap_factor`` of it, and whether there are points enough."""
    d = df.where(real_subject()).withColumn("x", finite("glucose"))
    rows = d.groupBy("id").agg(F.count("*").alias("readings"), F.count("x").alias("finite_glucose_rows"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count_if(F.col("x").isNotNull() & F.col("timestamp").isNotNull()).alias("usable_points"))
    median = median_interval(d.where("x is not null")).withColumnRenamed("id", "__id").withColumnRenamed("median_interval_minutes", "interval_minutes")
    gaps = intervals(d.where("x is not null")).select(F.col("id").alias("__gid"), "gap_minutes").join(median, F.col("__gid") == F.col("__id")).groupBy("__gid").agg(F.max("interval_minutes").alias("interval_minutes"), F.count_if(F.col("gap_minutes") > gap_factor * F.col("interval_minutes")).alias("gap_count"))
    out = rows.join(gaps, F.col("id") == F.col("__gid"), "left").drop("__gid").join(series_modes(df).withColumnRenamed("id", "__mid"), F.col("id") == F.col("__mid")).drop("__mid")
    eligible = F.col("usable_points") >= params.min_points
    note = F.concat(F.when(eligible, "Eligible. ").otherwise(F.concat(F.lit(f"Needs at least {params.min_points} "), by_mode(POINTS), F.lit(". "))), by_mode(SERIES_NOTES))
    gap_count = F.when(F.col("usable_points") < 2, F.lit(0)).when(F.col("interval_minutes").isNotNull(), F.coalesce("gap_count", F.lit(0)))
    return out.withColumns({"gap_count": gap_count, "series_note": by_mode(SERIES_NOTES), "eligible": eligible, "note": note})


def shannon(df: DataFrame, params: ComplexityParams = ComplexityParams()) -> DataFrame:
    """Entropy of glucose in right-closed bins, over the logarithm of the filled bins; a constant series has 0."""
    w = params.bin_width
    d = df.withColumn("x", finite("glucose")).where(real_subject() & F.col("x").isNotNull()).select("id", "x")
    low = d.groupBy("id").agg(F.min("x").alias("low")).select(F.col("id").alias("lid"), (F.floor(F.col("low") / w) * w).alias("low"))
    bins = d.groupBy("id", "x").agg(F.count("*").alias("c")).join(low, F.col("id") == F.col("lid")).groupBy("id", F.greatest(F.ceil((F.col("x") - F.col("low")) / w), F.lit(1)).alias("bin")).agg(F.sum("c").alias("c"))
    h = bins.groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("filled"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = (F.log("n") - F.col("clogc") / F.col("n")) / F.nullif(F.log("filled"), F.lit(0.0))
    return h.select("id", F.col("n").alias("readings"), F.when(F.col("filled") > 1, entropy).otherwise(0.0).alias("shannon_entropy"))


def dfa_windows(n: int) -> list[int]:
    """Eight window sizes, even in the logarithm, from 8 to a quarter of the series; those below 8 after rounding, from half of it, and repeated ones go."""
    out: list[int] = []
    if n < 32:
        return out
    a, b = math.log(8.0), math.log(math.floor(n / 4.0))
    for i in range(8):
        w = math.floor(math.exp(a + (b - a) * (i / 7.0)))
        if 8 <= w < n / 2 and w not in out[-1:]:
            out.append(w)
    return out


def dfa(df: DataFrame) -> DataFrame:
    """Detrended fluctuation per subject and window: ``id``, ``scale``, ``fluctuation``.

    The profile is a running sum carried over days; each segment's residual follows from sums.
    """
    s = numbered(df)
    mean = s.groupBy("id").agg(F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("size")).where("hi > lo and size >= 32")
    windows = F.udf(lambda n: dfa_windows(n), "array<int>")  # one call per subject
    mean = mean.withColumn("scales", windows("size")).drop("lo", "hi", "size")
    s = s.join(mean, "id").withColumn("dev", F.col("x") - F.col("mean"))
    days = s.groupBy("id", "day").agg(F.sum("dev").alias("d"))
    days = days.withColumn("carry", F.sum("d").over(Window.partitionBy("id").orderBy("day")) - F.col("d")).drop("d")
    s = s.withColumn("run", F.sum("dev").over(Window.partitionBy("id", "day").orderBy("i"))).join(days, ["id", "day"])
    s = s.select("id", "i", "n", (F.col("run") + F.col("carry")).alias("y"), F.explode("scales").alias("scale"))
    s = s.where(F.col("i") < F.floor(F.col("n") / F.col("scale")) * F.col("scale")).withColumn("t", (F.col("i") % F.col("scale")).cast("double"))
    seg = s.groupBy("id", "scale", F.floor(F.col("i") / F.col("scale")).alias("seg")).agg(F.var_pop("y").alias("vy"), F.var_pop("t").alias("vt"), F.covar_pop("y", "t").alias("cov"))
    f = seg.groupBy("id", "scale").agg(F.sqrt(F.avg(F.greatest(F.lit(0.0), F.col("vy") - F.col("cov") * F.col("cov") / F.col("vt")))).alias("fluctuation"))
    return f.where("fluctuation > 0")


def slope(curve: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """Least squares slope by subject, null with fewer than two points."""
    return curve.groupBy("id").agg(F.when(F.count("*") >= 2, F.regr_slope(y, x)).alias(name))


def dfa_alpha(df: DataFrame) -> DataFrame:
    return slope(dfa(df).select("id", F.log("fluctuation").alias("y"), F.log("scale").alias("x")), "y", "x", "dfa_alpha")


def higuchi(df: DataFrame, kmax: int = 8) -> DataFrame:
    """Mean curve length per subject and step k: ``id``, ``scale``, ``curve_length``.

    The points of one offset are k apart, so lengths are sums over (subject, k, offset); the
    neighbour k places on is met by an equi-join on the place.
    """
    s = numbered(df)
    varied = s.groupBy("id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("size")).where((F.col("hi") > F.col("lo")) & (F.col("size") >= 2 * kmax)).select("id")
    s = s.join(varied, "id").select("id", "i", "x", "n")
    ahead = s.select("id", "n", F.explode(F.sequence(F.lit(1), F.lit(kmax))).alias("k"), "i", "x").withColumn("j", F.col("i") + F.col("k"))
    met = ahead.join(s.select(F.col("id").alias("oid"), F.col("i").alias("oi"), F.col("x").alias("ox")), (F.col("id") == F.col("oid")) & (F.col("j") == F.col("oi")))
    length = met.groupBy("id", "k", "n", (F.col("i") % F.col("k")).alias("m")).agg((F.sum(F.abs(F.col("ox") - F.col("x"))) * (F.col("n") - 1) / (F.count("*") * F.col("k"))).alias("l"))
    return length.groupBy("id", F.col("k").alias("scale")).agg(F.avg("l").alias("curve_length")).where("curve_length > 0")


def higuchi_fd(df: DataFrame, kmax: int = 8) -> DataFrame:
    return slope(higuchi(df, kmax).select("id", F.log("curve_length").alias("y"), (-F.log("scale")).alias("x")), "y", "x", "higuchi_fd")


def hurst_windows(n: int) -> list[int]:
    """Segment lengths by halving, at least 8."""
    out = []
    while n >= 16:
        out.append(n)
        n //= 2
    return out


#: Readings of a subject, one after the other, that one row of ``blocks`` holds.
BLOCK = 1024


def blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """``id``, ``block``, ``n`` (readings of the subject) and ``x``: its values from place ``block * size`` on, in time order."""
    d = numbered(df).groupBy("id", F.floor(F.col("i") / size).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x"))
    return stored(d.select("id", "block", "n", F.transform("x", lambda v: v["x"]).alias("x")), "blocks")


def as_batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(values, columns.values(), strict=True)], list(columns))


#: Columns of ``segments_inside`` and ``segments_across``.
INSIDE = {"id": "string", "block": "long", "scale": "long", "seg": "long", "n": "long", "total": "double", "lo": "double", "hi": "double"}
ACROSS = {"id": "string", "block": "long", "scale": "long", "seg": "long", "n": "long", "dev": "double", "squares": "double", "low": "double", "high": "double"}


def segments_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and scale: number and sum of R/S of the segments that lie in the block (``seg`` null); of those that go beyond it, number, sum, least and largest of the values here."""
    for batch in batches:
        out = []
        for name, block, n, x in zip(*(batch.column(c).to_pylist() for c in ("id", "block", "n")), batch.column("x"), strict=True):
            x, at = x.values.to_numpy(zero_copy_only=False), block * BLOCK
            for scale in hurst_windows(n):
                stop = min(at + len(x), n // scale * scale)
                if stop <= at:
                    continue
                first, last = -(-at // scale), stop // scale
                if first < last:
                    y = x[first * scale - at : last * scale - at].reshape(-1, scale)
                    y = y[y.min(axis=1) < y.max(axis=1)]
                    dev = y - y.mean(axis=1, keepdims=True)
                    z, sd = dev.cumsum(axis=1), np.sqrt((dev * dev).mean(axis=1))
                    rs = (z.max(axis=1) - z.min(axis=1))[sd > 0] / sd[sd > 0]
                    out.append((name, block, scale, None, len(rs), float(rs.sum()), None, None))
                for a, b in [(at, first * scale), (last * scale, stop)] if first <= last else [(at, stop)]:
                    if a < b:
                        y = x[a - at : b - at]
                        out.append((name, block, scale, a // scale, len(y), float(y.sum()), float(y.min()), float(y.max())))
        yield as_batch(out, INSIDE)


def segments_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and segment of ``cut`` (scale, segment and its mean): number, sum and sum of squares of deviations in the block, least and largest of their running sums from its first on."""
    for batch in batches:
        out = []
        for name, block, x, cut in zip(*(batch.column(c).to_pylist() for c in ("id", "block")), batch.column("x"), batch.column("cut").to_pylist(), strict=True):
            x, at = x.values.to_numpy(zero_copy_only=False), block * BLOCK
            for c in cut:
                scale, seg = c["scale"], c["seg"]
                dev = x[max(seg * scale - at, 0) : (seg + 1) * scale - at] - c["mean"]
                z = dev.cumsum()
                out.append((name, block, scale, seg, len(z), float(z[-1]), float(dev @ dev), float(z.min()), float(z.max())))
        yield as_batch(out, ACROSS)


def hurst(df: DataFrame) -> DataFrame:
    """Hurst exponent by rescaled range, corrected by the range expected of independent values (Anis and Lloyd, Peters).

    Re-derived from the literature; slope of log R/S less its expectation, plus a half.  Readings stand
    in blocks, a row each, whatever the number of scales; a segment that goes beyond a block is put
    together from a row a block, so a reading is never repeated and a long segment is never in a task.
    """
    d = blocks(df)
    ddl = lambda columns: ", ".join(f"{c} {k}" for c, k in columns.items())
    parts = stored(d.mapInArrow(segments_inside, ddl(INSIDE)), "parts")
    key, beyond = ["id", "scale", "seg"], parts.where("seg is not null")
    means = beyond.groupBy(*key).agg((F.sum("total") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").drop("lo", "hi")
    cut = beyond.select(*key, "block").join(means, key).groupBy("id", "block").agg(F.collect_list(F.struct("scale", "seg", "mean")).alias("cut"))  # two a scale at most
    z = d.select("id", "block", "x").join(cut, ["id", "block"]).mapInArrow(segments_across, ddl(ACROSS))
    z = z.withColumn("carry", F.sum("dev").over(Window.partitionBy(*key).orderBy("block")) - F.col("dev"))
    spread = F.max(F.col("carry") + F.col("high")) - F.min(F.col("carry") + F.col("low"))
    long = z.groupBy(*key).agg((spread / F.nullif(F.sqrt(F.sum("squares") / F.sum("n")), F.lit(0.0))).alias("total")).where("total is not null")
    r = long.select("id", "scale", F.lit(1).cast("long").alias("n"), "total").unionByName(parts.where("seg is null and n > 0").select("id", "scale", "n", "total"))
    r = r.groupBy("id", "scale").agg((F.sum("total") / F.sum("n")).alias("rs")).where("rs > 0")
    expected = F.udf(lambda n: expected_range(n), "double")
    r = r.select("id", F.log("scale").alias("x"), (F.log("rs") - F.log(expected("scale"))).alias("y"))
    return slope(r, "y", "x", "h").select("id", (F.col("h") + 0.5).alias("hurst"))


def expected_range(n: int) -> float:
    """R/S expected of n independent normal values."""
    ratio = math.exp(math.lgamma((n - 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) if n <= 340 else 1 / math.sqrt(n * math.pi / 2)
    total = 0.0
    for start in range(1, n, 1 << 20):
        i = np.arange(start, min(start + (1 << 20), n))
        total += float(np.sqrt((n - i) / i).sum())
    return (n - 0.5) / n * ratio * total


def sample_entropy(x: np.ndarray, m: int, r: float) -> float:
    """-ln(A / B) over pairs of templates whose values lie within r; NaN where there are none."""
    n = len(x)
    if n <= m + 1 or not r > 0:
        return math.nan
    close = np.abs(x[:, None] - x[None, :]) <= r
    k = n - m
    b = np.ones((k, k), bool)
    for j in range(m):
        b &= close[j : j + k, j : j + k]
    upper = np.triu(b, 1)
    hits = int(upper.sum())
    more = int((upper & close[m : m + k, m : m + k]).sum())
    return -math.log(more / hits) if hits and more else math.nan


def mse(df: DataFrame, params: ComplexityParams = ComplexityParams()) -> DataFrame:
    """Sample entropy per subject and scale: ``id``, ``scale``, ``sample_entropy``; the tolerance is a share of each coarse series' SD.

    Series are thinned evenly to ``thin_to`` points before a subject's points meet in a task;
    ``thin_to`` None takes them whole (``mse_whole``).
    """
    if params.thin_to is None:
        return mse_whole(df, params)
    s, most = numbered(df), params.thin_to
    place = lambda k: F.floor(F.col(k) * (F.col("n") - 1) / (most - 1) + 0.5)  # noqa: E731  the k-th of the points kept
    nearest = F.floor(F.col("i") * (most - 1) / (F.col("n") - 1) + 0.5)
    thin = s.withColumn("k0", nearest).withColumns({"k1": F.col("k0") - 1, "k2": F.col("k0") + 1})
    kept = (F.col("n") <= most) | (place("k0") == F.col("i")) | (place("k1") == F.col("i")) | (place("k2") == F.col("i"))

    def scales(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = pdf.sort_values("i")["x"].to_numpy(), []
        for scale in range(1, params.scales + 1):
            n = len(x) // scale
            coarse = x[: n * scale].reshape(n, scale).mean(axis=1)
            if n > params.embedding + 1 and np.ptp(coarse) > 0:
                e = sample_entropy(coarse, params.embedding, params.tolerance * coarse.std(ddof=1))
                if math.isfinite(e):
                    out.append((key[0], scale, e))
        return pd.DataFrame(out, columns=["id", "scale", "sample_entropy"])

    return thin.where(kept).select("id", "i", "x").groupBy("id").applyInPandas(scales, "id string, scale int, sample_entropy double")


#: Templates of a cell that meet others at a time, and those of them that one set of bits covers.
CELL_ROWS, SET = 32768, 2048
#: Fixed value: up to so many pairs are compared one by one.
FEW_PAIRS = 1 << 17
#: Columns of ``coarse_series``: templates, or, with ``x`` null, moments of a block's part of the coarse series.
COARSE = pa.schema([("id", pa.string()), ("scale", pa.int32()), ("x", pa.list_(pa.float64())), ("times", pa.int64()), ("n", pa.int64()), ("mean", pa.float64()), ("squares", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())])


def distinct_templates(c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``m + 1`` values of ``c``, and how often each is there."""
    if len(c) <= m:
        return np.empty((0, m + 1)), np.empty(0, np.int64)
    t = np.lib.stride_tricks.sliding_window_view(c, m + 1)
    t = t[np.lexsort(t.T)]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]).any(axis=1)))
    return t[new], np.diff(new, append=len(t))


def coarse_series(rows: pa.RecordBatch, size: int, m: int, scales: int) -> pa.RecordBatch:
    """Of blocks of ``size`` readings, each with the ``head`` of the next: by scale, the templates that start in it, and moments of its own coarse values."""
    of, values, times, moments = [], [], [], []
    for name, block, n, x, head in zip(*(rows.column(c).to_pylist() for c in ("id", "block", "n")), rows.column("x"), rows.column("head"), strict=True):
        x, at = x.values.to_numpy(zero_copy_only=False), block * size
        if head.is_valid:
            x = np.append(x, head.values.to_numpy(zero_copy_only=False))
        for scale in range(1, scales + 1):
            first, points = -(-at // scale), n // scale
            last = min(-(-(at + size) // scale), points)
            if first < last:
                c = x[first * scale - at : min(last + m, points) * scale - at].reshape(-1, scale).mean(axis=1)
                own = c[: last - first]
                dev = own - own.mean()
                moments.append((len(own), float(own.mean()), float(dev @ dev), float(own.min()), float(own.max())))
                found, often = distinct_templates(c, m)
                of.append((name, scale, len(found)))
                values.append(found.ravel())
                times.append(often)
    repeats, k = np.array([n for _, _, n in of], np.int64), len(of)
    total = int(repeats.sum())
    keys = [pa.array([name for name, _, _ in of], pa.string()), pa.array([scale for _, scale, _ in of], pa.int32())]
    where = pa.array(np.repeat(np.arange(k), repeats))
    x = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * (m + 1), pa.int32()), pa.array(np.concatenate([*values, []]), pa.float64()))
    found = [*(c.take(where) for c in keys), x, pa.array(np.concatenate([*times, []]), pa.int64()), *(pa.nulls(total, f.type) for f in list(COARSE)[4:])]
    parts = [*keys, *(pa.nulls(k, f.type) for f in list(COARSE)[2:4]), *(pa.array([row[j] for row in moments], f.type) for j, f in enumerate(list(COARSE)[4:]))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(both) for both in zip(found, parts, strict=True)], schema=COARSE)


def templates(df: DataFrame, params: ComplexityParams) -> DataFrame:
    """``id``, ``scale``, ``x`` (``embedding + 1`` values of the coarse series, one after the other), ``times`` (how often a block of readings has it) and ``r``, the tolerance."""
    m, scales = params.embedding, params.scales
    ahead = (m + 1) * scales - 1  # readings after a block that its templates reach into
    size = max(BLOCK, ahead)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (coarse_series(batch.slice(start, 64), size, m, scales) for start in range(0, batch.num_rows, 64))

    d = blocks(df, size)
    heads = d.where("block > 0").select("id", (F.col("block") - 1).alias("block"), F.slice("x", 1, ahead).alias("head"))
    coarse = stored(d.join(heads, ["id", "block"], "left").mapInArrow(cut, "id string, scale int, x array<double>, times long, n long, mean double, squares double, lo double, hi double"), "coarse")
    parts, off = coarse.where("x is null"), F.col("mean") - F.col("centre")
    totals = parts.groupBy("id", "scale").agg(F.sum("n").alias("points"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    totals = totals.where((F.col("points") > m + 1) & (F.col("least") < F.col("most"))).select("id", "scale", "points", "centre")
    variance = F.sum(F.col("squares") + F.col("n") * off * off) / (F.max("points") - 1)
    spread = stored(parts.join(totals, ["id", "scale"]).groupBy("id", "scale").agg((params.tolerance * F.sqrt(variance)).alias("r")).where("r > 0"), "spread")
    return coarse.where("x is not null").select("id", "scale", "x", "times").join(spread, ["id", "scale"])


def cell_blocks(batches: Iterator[pa.RecordBatch], wide: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of templates, those of a cell one after the other: blocks of at most ``most`` different ones of a cell, as ``xs``, each followed by its number.

    No more than 16 blocks of a cell are held at a time; equal templates beyond that may be in two blocks.
    """
    key, held, waiting, number = None, [], 0, 0

    def flush() -> list[tuple]:
        nonlocal held, waiting, number
        if not held:
            return []
        t = np.concatenate(held)
        t = t[np.lexsort(t[:, :wide].T)]
        new = np.flatnonzero(np.append(True, (t[1:, :wide] != t[:-1, :wide]).any(axis=1)))
        t = np.column_stack([t[new, :wide], np.add.reduceat(t[:, wide], new)])
        out = [(*key[:-1], number + k, key[-1], t[start : start + most].ravel()) for k, start in enumerate(range(0, len(t), most))]
        held, waiting, number = [], 0, number + len(out)
        return out

    def as_blocks(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 4), pa.float64(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names: list[str] = []
    for batch in batches:
        keys = batch.schema.names[:-3]  # id, scale, the cell and r
        names, out = [*keys[:-1], "block", "r", "xs"], []
        x = batch.column("x")
        t = np.column_stack([x.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide), batch.column("times").to_numpy(zero_copy_only=False)])
        columns = [batch.column("id").dictionary_encode().indices, *(batch.column(k) for k in keys[1:])]
        change = np.zeros(max(len(t) - 1, 0), bool)
        for c in (c.to_numpy(zero_copy_only=False) for c in columns):
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
        firsts = batch.select(keys).take(pa.array(cuts[:-1], pa.int64())).to_pylist() if len(t) else []
        for start, stop, row in zip(cuts, cuts[1:], firsts, strict=False):
            if tuple(row.values()) != key or waiting > 16 * most:
                out += flush()
                key = tuple(row.values())
            held.append(t[start:stop])
            waiting += stop - start
        if out:
            yield as_blocks(out, names)
    if held:
        yield as_blocks(flush(), names)


def bounds(a: np.ndarray, values: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``a`` the place of the first of ``values``, which rise, that lies within r, and the place after the last."""
    lo, hi, n = np.searchsorted(values, a - r, "left"), np.searchsorted(values, a + r, "right"), len(values)
    # a - r and a + r are rounded; what counts is the rounded difference.
    for at, holds in ((lo, lambda v: a - v > r), (hi, lambda v: v - a <= r)):
        while (up := (at < n) & holds(values[np.minimum(at, n - 1)])).any():
            at += up
        while (down := (at > 0) & ~holds(values[np.maximum(at - 1, 0)])).any():
            at -= down
    return lo, hi


def prefixes(order: np.ndarray) -> np.ndarray:
    """Row k: the set of the first k places of ``order``, a bit for each place."""
    out = np.zeros((-(-len(order) // 64), len(order) + 1), np.uint64)
    out[order >> 6, np.arange(1, len(order) + 1)] = np.uint64(1) << (order & 63).astype(np.uint64)
    return np.ascontiguousarray(np.bitwise_or.accumulate(out, axis=1).T)


def summed(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    return np.append(0, np.cumsum(values))


def near_pairs(a: np.ndarray, b: np.ndarray, r: float) -> tuple[int, int]:
    """Pairs of a row of ``a`` and one of ``b`` with all values but the last within r, and with that, too.

    The column after the values says how often a row counts.  Rows of ``b`` lie in the order of their last value;
    of ``SET`` at a time, those within r of a row's value are a set of bits, the difference of two
    prefixes of their order, and a row's pairs are the bits that the sets of its values share.
    """
    m = a.shape[1] - 2
    if len(a) * len(b) <= FEW_PAIRS:
        near = np.ones((len(a), len(b)), bool)
        for k in range(m):
            near &= np.abs(a[:, k, None] - b[:, k]) <= r
        more = near & (np.abs(a[:, m, None] - b[:, m]) <= r)
        return int(a[:, -1] @ (near @ b[:, -1])), int(a[:, -1] @ (more @ b[:, -1]))
    if len(a) < len(b):
        a, b = b, a
    a, b = a[np.argsort(a[:, m], kind="stable")], b[np.argsort(b[:, m], kind="stable")]
    often, times = a[:, -1].astype(np.int64), b[:, -1].astype(np.int64)
    sides, ranks = {}, {}
    for k in range(m + 1):
        if k == m or max(a[:, k].max() - b[:, k].min(), b[:, k].max() - a[:, k].min()) > r:  # else all are near by this value
            values, ranks[k] = np.unique(b[:, k], return_inverse=True)
            sides[k] = bounds(a[:, k], values, r)
    below = summed(np.bincount(ranks[m]))
    start, stop = (below[v] for v in sides.pop(m))  # those of b that are near by the last value
    hits = more = 0
    if not sides:
        upto = summed(times)
        hits, more = int(often.sum()) * int(upto[-1]), int(often @ (upto[stop] - upto[start]))
    if len(sides) == 1:
        (k, (lo, hi)), = sides.items()
        upto = summed(np.bincount(ranks[k], times).astype(np.int64))
        hits = int(often @ (upto[hi] - upto[lo]))
    for at in range(0, len(b) if sides else 0, SET):
        part = times[at : at + SET]
        size, words = len(part), -(-len(part) // 64)
        last, sets = prefixes(np.arange(size)), []
        for k, (lo, hi) in sides.items():
            rank = ranks[k][at : at + SET]
            upto = summed(np.bincount(rank, minlength=int(hi.max()) + 1))
            sets.append((prefixes(np.argsort(rank, kind="stable")), upto[lo] if lo.any() else None, upto[hi]))
        # How often rows of b count is told bit by bit.
        planes = [None] if part.max() == 1 else [np.packbits(np.append(part >> j & 1, np.zeros(words * 64 - size, np.int64)).astype(np.uint8), bitorder="little").view(np.uint64) for j in range(int(part.max()).bit_length())]
        ones = np.ones(words, np.float32)

        def weight(near: np.ndarray, rows: slice) -> int:
            return sum(int(often[rows] @ (np.bitwise_count(near if p is None else near & p).astype(np.float32) @ ones).astype(np.int64)) << j for j, p in enumerate(planes))

        here = slice(int(np.searchsorted(stop, at, "right")), int(np.searchsorted(start, at + size, "left")))  # rows of a with a near last value in this part
        whole = len(sides) > 1
        for first in range(0 if whole else here.start, len(a) if whole else here.stop, SET):
            rows = slice(first, min(first + SET, len(a) if whole else here.stop))
            near = None
            for table, lo, hi in sets:
                found = table.take(hi[rows], axis=0, mode="clip")
                if lo is not None:
                    found ^= table.take(lo[rows], axis=0, mode="clip")
                near = found if near is None else np.bitwise_and(near, found, out=near)
            if whole:
                hits += weight(near, rows)
            inside = slice(max(first, here.start), min(rows.stop, here.stop))
            if inside.start < inside.stop:
                near = near[inside.start - first : inside.stop - first]
                near &= last.take(np.clip(stop[inside] - at, 0, size), axis=0, mode="clip") ^ last.take(np.clip(start[inside] - at, 0, size), axis=0, mode="clip")
                more += weight(near, inside)
    return hits, more


def mse_whole(df: DataFrame, params: ComplexityParams = ComplexityParams()) -> DataFrame:
    """``mse`` of whole series.

    Templates lie in cells a hair wider than the tolerance by their first two values (one, if the
    embedding has no more), so those within the tolerance are in the same cell or next to each other.  A cell is cut into
    blocks of at most ``CELL_ROWS`` templates, and blocks of the same cell or of neighbours meet, each
    pair once: what is counted is compared exactly, and no task has more than two blocks at a time.
    Equal templates are one, with their number, so the work grows with the square of distinct ones, some 64 pairs at a step (``near_pairs``).
    """
    m, dims = params.embedding, min(2, params.embedding)
    width = F.col("r") * (1 + 1e-9)
    cell = [F.floor(F.get("x", F.lit(k)) / width).alias(f"c{k}") for k in range(dims)]
    cells = ["id", "scale", *(f"c{k}" for k in range(dims))]
    d = templates(df, params).select("id", "scale", *cell, "r", "x", "times")
    ddl = "id string, scale int, " + ", ".join(f"c{k} long" for k in range(dims)) + ", block long, r double, xs array<double>"
    rows, wide = CELL_ROWS, m + 1
    blocks = stored(d.withColumn("cell", F.xxhash64(*cells)).repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: cell_blocks(batches, wide, rows), ddl), "templates")
    same = [F.col(c) == F.col(f"__{c}") for c in cells]
    # Every cell beside or above in one direction, so that two cells meet once; a cell meets itself block by block.
    ways = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if dims == 2 else [(0,), (1,)]
    way = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"w{k}") for k, v in enumerate(w))) for w in ways))).alias("way")
    left = blocks.select(*cells, "block", "r", "xs", way).select("id", "scale", *((F.col(f"c{k}") + F.col(f"way.w{k}")).alias(f"c{k}") for k in range(dims)), "block", "r", "xs", (F.greatest(*(F.abs(f"way.w{k}") for k in range(dims)), F.lit(0)) == 0).alias("own"))
    right = blocks.select(*(F.col(c).alias(f"__{c}") for c in cells), F.col("block").alias("__block"), F.col("xs").alias("__xs"))
    pairs = left.join(right, same).where(~F.col("own") | (F.col("block") <= F.col("__block")))
    pairs = pairs.select("id", "scale", "r", "xs", "__xs", (F.col("own") & (F.col("block") == F.col("__block"))).alias("itself"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, a, b, itself in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True):
                a, b = (v.values.to_numpy(zero_copy_only=False).reshape(-1, m + 2) for v in (a, b))
                hits, more = near_pairs(a, b, r)
                # Within a block every pair is seen from both sides, and each template meets itself.
                own = int(b[:, -1].sum())
                out.append(((hits - own) // 2, (more - own) // 2) if itself else (hits, more))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h for h, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["id", "scale", "hits", "more"])

    totals = pairs.mapInArrow(count, "id string, scale int, hits long, more long").groupBy("id", "scale").agg(F.sum("hits").alias("hits"), F.sum("more").alias("more")).where("hits > 0 and more > 0")
    return totals.select("id", "scale", (-F.log(F.col("more") / F.col("hits"))).alias("sample_entropy"))


def complexity_curves(df: DataFrame, params: ComplexityParams = ComplexityParams()) -> DataFrame:
    """All curves in one long table: ``id``, ``curve``, ``scale_value``, ``metric_value``."""
    part = lambda d, name, v: d.select("id", F.lit(name).alias("curve"), F.col("scale").cast("double").alias("scale_value"), F.col(v).alias("metric_value"))
    return part(dfa(df), "DFA", "fluctuation").unionByName(part(higuchi(df, params.kmax), "Higuchi", "curve_length")).unionByName(part(mse(df, params), "Multiscale entropy", "sample_entropy"))


#: Measures that have a note of their own where they are missing.
NAMED = {"hurst": "Hurst exponent", "dfa_alpha": "DFA alpha", "higuchi_fd": "Higuchi fractal dimension"}


def complexity_metrics(df: DataFrame, params: ComplexityParams = ComplexityParams()) -> DataFrame:
    """One row per subject; subjects with fewer than ``min_points`` readings have nulls and a note, and a measure that others have no value for has a note of its own.

    The scalar sample, approximate and multiscale entropies are always null; multiscale entropy is a curve.
    """
    base = shannon(df, params)
    enough = F.col("readings") >= params.min_points
    out = base
    for part in (hurst(df), dfa_alpha(df), higuchi_fd(df, params.kmax)):
        out = out.join(part, "id", "left")
    values = {c: F.when(enough, F.col(c)) for c in ("shannon_entropy", "hurst", "dfa_alpha", "higuchi_fd")}
    nulls = {c: F.lit(None).cast("double") for c in ("sample_entropy", "approximate_entropy", "multiscale_sample_entropy")}
    notes = {f"{c}_note": F.when(enough & F.col(c).isNull(), f"{name} could not be computed for this series.").otherwise("") for c, name in NAMED.items()}
    return out.withColumns(notes | values | nulls | {"note": F.when(~enough, f"Fewer than {params.min_points} readings").otherwise("")})

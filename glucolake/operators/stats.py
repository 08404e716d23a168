"""Comparing two groups of subjects on a metric: summaries, Welch's t, rank sum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.functions.columns import with_sum_below
from glucolake.functions.tables import stored

#: Groups that a comparison lists by name; of more it gives the number.
NAMED_GROUPS = 1000
NOT_GROUPING = frozenset("id id_source timestamp glucose units device source_file imputed_flag metric_period metric_engine lag_status risk_status _ord".split())


def analysis_rows(metrics: DataFrame, metric: str, grouping: str = "group", period: str = "full_day") -> DataFrame:
    """``group``, ``value`` of the period, without nulls and blank groups."""
    d = metrics.where(F.col("metric_period") == period) if "metric_period" in metrics.columns else metrics
    return d.select(F.trim(F.col(grouping).cast("string")).alias("group"), F.col(metric).cast("double").alias("value")).where("group <> '' and value is not null and not isnan(value)")


def group_summary(metrics: DataFrame, metric: str, grouping: str = "group", period: str = "full_day") -> DataFrame:
    """N, mean, SD, median, IQR, minimum and maximum of a metric by group."""
    r = lambda c, n: F.round(c, 2).alias(n)
    return analysis_rows(metrics, metric, grouping, period).groupBy("group").agg(
        F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "sd"), r(F.percentile("value", 0.5), "median"),
        r(F.percentile("value", 0.75) - F.percentile("value", 0.25), "iqr"), r(F.min("value"), "minimum"), r(F.max("value"), "maximum"),
    )


def moments(metrics: DataFrame, metric: str, grouping: str = "group", period: str = "full_day") -> DataFrame:
    """What Welch's test needs: size, mean and variance by group."""
    return analysis_rows(metrics, metric, grouping, period).groupBy("group").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def rank_sums(metrics: DataFrame, metric: str, grouping: str = "group", period: str = "full_day") -> DataFrame:
    """What the rank sum test needs: size, sum of midranks and the tie term by group.

    Values are counted by distinct value first; ranks are sums of those counts.  The metrics are
    computed once and stored.
    """
    rows = stored(analysis_rows(metrics, metric, grouping, period), "values")
    ties = rows.groupBy("value").agg(F.count("*").alias("t"))
    ties = with_sum_below(ties, "value", "t", store=False).withColumn("midrank", F.col("below") + (F.col("t") + 1) / 2).drop("below")
    term = ties.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"))
    return rows.join(ties, "value").groupBy("group").agg(F.count("*").alias("n"), F.sum("midrank").alias("rank_sum")).crossJoin(F.broadcast(term))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def welch(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float, float]:
    """Statistic, degrees of freedom and two-sided p-value."""
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        return (math.nan if m1 == m2 else math.copysign(math.inf, m1 - m2)), math.nan, math.nan
    t, df = (m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, incomplete_beta(df / 2, 0.5, df / (df + t * t))


def rank_sum(n1: int, n2: int, sum1: float, tie_term: float) -> tuple[float, float]:
    """W of the first group and the two-sided p-value of the normal approximation, with tie and continuity corrections."""
    w, n = sum1 - n1 * (n1 + 1) / 2, n1 + n2
    z = w - n1 * n2 / 2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - tie_term / (n * (n - 1))))
    if sigma == 0:
        return w, math.nan
    z = (z - math.copysign(0.5, z) * (z != 0)) / sigma
    return w, math.erfc(abs(z) / math.sqrt(2))


def compare_groups(metrics: DataFrame, metric: str, grouping: str = "group", test: str = "welch_t", period: str = "full_day") -> DataFrame:
    """One row: groups, sizes, statistic and p-value, or a note why there is no test.  Only a row per group comes to the driver."""
    if test not in ("welch_t", "wilcoxon"):
        raise ValueError("test is 'welch_t' or 'wilcoxon'")
    spark = metrics.sparkSession
    schema = "metric string, grouping string, test string, groups string, n string, statistic double, p_value double, note string"
    if grouping not in metrics.columns:
        return spark.createDataFrame([(metric, grouping, test, "", "", None, None, "Selected grouping variable is not available.")], schema)
    sizes = analysis_rows(metrics, metric, grouping, period).groupBy("group").agg(F.count("*").alias("n"))
    if (groups := sizes.count()) > NAMED_GROUPS:
        return spark.createDataFrame([(metric, grouping, test, f"{groups} groups", "", None, None, "Select a grouping variable with exactly two groups for this test.")], schema)
    # Ranks are taken only where there is a test to make.
    found = rank_sums if test == "wilcoxon" and groups == 2 else moments
    rows = sorted(found(metrics, metric, grouping, period).collect(), key=lambda r: r["group"])
    names, sizes = " vs ".join(r["group"] for r in rows), " / ".join(str(r["n"]) for r in rows)
    note = "Select a grouping variable with exactly two groups for this test." if len(rows) != 2 else "At least two observations per group are required." if min(r["n"] for r in rows) < 2 else ""
    if note:
        return spark.createDataFrame([(metric, grouping, test, names, sizes, None, None, note)], schema)
    a, b = rows
    if test == "welch_t":
        s, _, p = welch(a["n"], a["mean"], a["variance"], b["n"], b["mean"], b["variance"])
    else:
        s, p = rank_sum(a["n"], b["n"], a["rank_sum"], a["tie_term"])
    return spark.createDataFrame([(metric, grouping, test, names, sizes, None if math.isnan(s) else s, None if math.isnan(p) else p, "")], schema)


def grouping_columns(metrics: DataFrame) -> list[str]:
    """Columns that split subjects in exactly two: text, not numbers, two distinct non-blank values; ``group`` and ``sex`` first."""
    names = [f.name for f in metrics.schema if f.dataType.simpleString() in ("string", "boolean") and f.name not in NOT_GROUPING]
    if not names:
        return []
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    row = metrics.agg(*(F.count_distinct(text(c)).alias(f"n_{c}") for c in names), *(F.count_if(text(c).isNotNull() & text(c).try_cast("double").isNull()).alias(f"t_{c}") for c in names)).first()
    found = [c for c in names if row[f"n_{c}"] == 2 and row[f"t_{c}"] > 0]
    return sorted(found, key=lambda c: (c != "group", c != "sex", names.index(c)))

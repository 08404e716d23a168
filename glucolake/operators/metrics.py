"""Glucose metrics by subject and time of day: base measures, risk indices, excursions, lagged differences, displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import Thresholds
from glucolake.functions.columns import MICROS_PER_MINUTE, finite, is_daytime, micros, minute_of_day, percent, with_previous

KEYS = ("id", "id_source", "group", "metric_period")
LAGS = {"conga_12h": 12 * 3600, "conga_24h": 24 * 3600}


def keys_of(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def with_periods(df: DataFrame) -> DataFrame:
    """Each row once for the full day and once for its time of day; rows without a timestamp for the full day only."""
    part = F.when(is_daytime(), "daytime").when(~is_daytime(), "nighttime")
    return df.withColumn("metric_period", F.explode(F.filter(F.array(F.lit("full_day"), part), lambda x: x.isNotNull())))


def base_metrics(df: DataFrame, thresholds: Thresholds = Thresholds(), keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Fifteen measures per group; a group without a reading has a row with ``readings`` 0 and nulls.

    With ``order``, a column that tells the rows of a group apart, ``mean_glucose`` adds readings
    one after the other in that order, so it is the same to the last bit wherever the rows lie:
    what compares means for equality (ranks, ties) needs that.  A group's rows then pass through one task.
    """
    t, g, keys = thresholds, F.col("glucose"), keys_of(df) if keys is None else keys
    d, mean = df.withColumn("glucose", finite("glucose")), F.avg(g)
    if order:
        d = d.withColumn("__sum", F.sum(g).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        mean = F.max_by("__sum", order) / F.nullif(F.count(g), F.lit(0))
    return d.groupBy(*keys).agg(
        F.count(g).alias("readings"), mean.alias("mean_glucose"), F.percentile(g, 0.5).alias("median_glucose"), F.stddev_samp(g).alias("sd_glucose"),
        (100 * F.stddev_samp(g) / F.nullif(F.avg(g), F.lit(0.0))).alias("cv_percent"), F.min(g).alias("min_glucose"), F.max(g).alias("max_glucose"),
        percent((g >= t.tir_lower) & (g <= t.tir_upper), g).alias("tir_percent"), percent(g < t.tir_lower, g).alias("tbr_percent"), percent(g > t.tir_upper, g).alias("tar_percent"),
        percent(g < t.tbr_level2, g).alias("tbr_level2_percent"), percent((g >= t.tbr_level2) & (g < t.tir_lower), g).alias("tbr_level1_percent"),
        percent((g > t.tir_upper) & (g <= t.tar_level2), g).alias("tar_level1_percent"), percent(g > t.tar_level2, g).alias("tar_level2_percent"),
        (3.31 + 0.02392 * F.avg(g)).alias("gmi_percent"),
    )


def risk(g: Column) -> Column:
    """The symmetrised risk of a glucose value; below 1 mg/dL it isn't defined."""
    return F.when(g > 1, 1.509 * (F.pow(F.log(g), 1.084) - 5.381))


def risk_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """LBGI, HBGI and J-index per group, over positive readings."""
    d = df.withColumn("g", F.when(finite("glucose") > 0, F.col("glucose"))).withColumn("f", risk(F.col("g")))
    n = F.nullif(F.count("g"), F.lit(0))
    return d.groupBy(*(keys_of(df) if keys is None else keys)).agg(
        (F.coalesce(F.sum(F.when(F.col("f") < 0, 10 * F.col("f") * F.col("f"))), F.lit(0.0)) / n).alias("lbgi"),
        (F.coalesce(F.sum(F.when(F.col("f") > 0, 10 * F.col("f") * F.col("f"))), F.lit(0.0)) / n).alias("hbgi"),
        (0.001 * F.pow(F.avg("g") + F.stddev_samp("g"), 2)).alias("j_index"),
    )


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    d = df.withColumn("glucose", finite("glucose")).where(F.col("timestamp").isNotNull() & F.col("glucose").isNotNull())
    return d.select(F.struct(*keys).alias("k"), "timestamp", "glucose", "_ord")


def mage(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean amplitude of glycemic excursions: turning points of the series, and of the steps between neighbouring ones those of an SD or more.

    Groups of fewer than four readings have null.
    """
    keys = keys_of(df) if keys is None else keys
    d = _keyed(df, keys)
    order = ("timestamp", "_ord")
    s = with_previous(d, {"p1": F.col("glucose")}, order, "k", second={"p1": "p2"})
    # The row before is a turning point if it lies above (or below) both neighbours, level with the earlier one at most.
    turn = ((F.col("p1") >= F.col("p2")) & (F.col("p1") > F.col("glucose"))) | ((F.col("p1") <= F.col("p2")) & (F.col("p1") < F.col("glucose")))
    points = with_previous(s.where(turn), {"last": F.col("p1")}, order, "k").select("k", F.abs(F.col("p1") - F.col("last")).alias("step"))
    sd = d.groupBy("k").agg(F.count("*").alias("n"), F.stddev_samp("glucose").alias("sd"))
    out = sd.join(points.withColumnRenamed("k", "pk"), F.col("k").eqNullSafe(F.col("pk")), "left").groupBy("k").agg(F.avg(F.when((F.col("n") >= 4) & (F.col("sd") > 0) & (F.col("step") >= F.col("sd")), F.col("step"))).alias("mage"))
    return out.select("k.*", "mage")


def lag_tolerance(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per group (struct ``k``) the seconds within which a reading counts as the one a lag later: 0 for a regular series, else 0.51 of the median interval, a minute at least."""
    d = with_previous(_keyed(df, keys_of(df) if keys is None else keys), {"__ts": micros()}, ("timestamp", "glucose"), "k")
    gap = (micros() - F.col("__ts")) / 1_000_000
    median = F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5)
    m = d.withColumn("gap", gap).groupBy("k").agg(median.alias("median"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    off = F.greatest(F.col("most") - F.col("median"), F.col("median") - F.col("least"))
    tolerance = F.when(off <= F.greatest(F.lit(1.0), 1e-6 * F.col("median")), F.lit(0.0)).otherwise(F.greatest(F.lit(60.0), 0.51 * F.col("median")))
    return m.select("k", F.when(F.col("median").isNotNull(), tolerance).alias("tolerance"))


def lag_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """CONGA at 12 and 24 hours and MODD: each reading against the nearest one a lag later, within the group's tolerance, the earliest on ties.

    Readings (one of equal times, the least) and wanted times lie in one table by group and quarter of a
    day.  The last reading up to a time and the first from it on come from running windows over a quarter, or
    from the nearest quarter that has readings: a reading is met twice, however many are within the tolerance.
    """
    keys = keys_of(df) if keys is None else keys
    d = _keyed(df, keys).withColumn("us", micros())
    none = F.lit(None)
    seen = d.groupBy("k", "us").agg(F.min("glucose").alias("g")).select("k", F.col("us").alias("t"), F.struct("us", "g").alias("seen"), none.cast("double").alias("glucose"), none.cast("int").alias("lag"))
    wanted = d.select("k", "us", "glucose", F.explode(F.array(*map(F.lit, LAGS.values()))).alias("lag"))
    wanted = wanted.select("k", (F.col("us") + F.col("lag").cast("long") * 1_000_000).alias("t"), none.cast("struct<us: long, g: double>").alias("seen"), "glucose", "lag")
    rows = seen.unionByName(wanted).withColumn("part", F.floor(F.col("t") / (360 * MICROS_PER_MINUTE)))
    here, across = Window.partitionBy("k", "part"), Window.partitionBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("k", "part").agg(F.min("seen").alias("first"), F.max("seen").alias("last"))
    parts = parts.select(F.col("k").alias("pk"), F.col("part").alias("at"), F.last("last", True).over(across.orderBy("part")).alias("earlier"), F.last("first", True).over(across.orderBy(F.desc("part"))).alias("later"))
    rows = rows.withColumns({"before": F.last("seen", True).over(here.orderBy("t")), "after": F.last("seen", True).over(here.orderBy(F.desc("t")))}).where("lag is not null")
    rows = rows.join(parts, rows["k"].eqNullSafe(parts["pk"]) & (rows["part"] == parts["at"]))
    rows = rows.select("k", "t", "glucose", "lag", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    back, on = F.col("t") - F.col("before.us"), F.col("after.us") - F.col("t")
    near = rows.select("k", "glucose", "lag", F.least(back, on).alias("apart"), F.when(back <= F.coalesce(on, back), F.col("before.g")).otherwise(F.col("after.g")).alias("then"))
    t = lag_tolerance(df, keys).withColumnRenamed("k", "tk").where("tolerance is not null")
    near = near.join(t, near["k"].eqNullSafe(t["tk"])).where(F.col("apart") <= F.col("tolerance") * 1_000_000)
    diff = F.col("then") - F.col("glucose")
    found = near.groupBy("k").agg(
        *(F.stddev_samp(F.when(F.col("lag") == by, diff)).alias(n) for n, by in LAGS.items()), F.avg(F.when(F.col("lag") == LAGS["conga_24h"], F.abs(diff))).alias("modd"),
    )
    every = df.groupBy(F.struct(*keys).alias("ek")).agg(F.lit(1).alias("one"))
    return every.join(found, every["ek"].eqNullSafe(found["k"]), "left").select("ek.*", *LAGS, "modd")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; ``b``'s keys go."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond, how).drop(*(f"__{k}" for k in keys))


def core_metrics(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Base, lag and risk metrics per subject and period, in one wide table."""
    d = with_periods(df)
    keys = keys_of(d)
    out = base_metrics(d, thresholds, keys)
    for part in (lag_metrics(d, keys), risk_metrics(d, keys), mage(d, keys)):
        out = null_safe_join(out, part, keys)
    lag_ok, risk_ok = (F.when(F.coalesce(*cols).isNotNull(), "ok").otherwise("unavailable") for cols in ([*map(F.col, LAGS), F.col("modd")], [F.col("lbgi")]))
    return out.withColumns({"lag_status": lag_ok, "risk_status": risk_ok, "metric_engine": F.lit("base+lag+risk")})


def attach_metadata(metrics: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Subject metadata beside metrics.  A column is kept only if no subject has more than one value of it (checked by one small aggregate)."""
    per = df.groupBy("id").agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns), *(F.max(c).alias(c) for c in columns))
    most = per.agg(*(F.max(f"n_{c}").alias(c) for c in columns)).first()
    keep = [c for c in columns if (most[c] or 0) <= 1 and c not in metrics.columns]
    return null_safe_join(metrics, per.select("id", *keep), ["id"]) if keep else metrics


def catalog(thresholds: Thresholds = Thresholds()) -> list[tuple[str, str, str, str, int, int]]:
    """Raw name, label, category, units, digits and order of each metric (fixed values)."""
    n = lambda x: f"{x:g}"
    lo, hi, lo2, hi2 = thresholds.tir_lower, thresholds.tir_upper, thresholds.tbr_level2, thresholds.tar_level2
    rows = [
        ("readings", "Readings", "Data Coverage", "count", 0),
        ("mean_glucose", "Mean glucose", "Central Tendency", "mg/dL", 1), ("median_glucose", "Median glucose", "Central Tendency", "mg/dL", 1),
        ("min_glucose", "Minimum glucose", "Central Tendency", "mg/dL", 1), ("max_glucose", "Maximum glucose", "Central Tendency", "mg/dL", 1),
        ("sd_glucose", "Standard deviation", "Variability", "mg/dL", 1), ("cv_percent", "Coefficient of variation", "Variability", "%", 1),
        ("gmi_percent", "Glucose management indicator", "Risk", "%", 2),
        ("tir_percent", f"Time in range ({n(lo)}-{n(hi)} mg/dL)", "Time in Range", "%", 1), ("tbr_percent", f"Time below range (<{n(lo)} mg/dL)", "Time in Range", "%", 1),
        ("tar_percent", f"Time above range (>{n(hi)} mg/dL)", "Time in Range", "%", 1), ("tbr_level2_percent", f"Level 2 below range (<{n(lo2)} mg/dL)", "Detailed Range Bands", "%", 1),
        ("tbr_level1_percent", f"Level 1 below range ({n(lo2)}-{n(lo - 1)} mg/dL)", "Detailed Range Bands", "%", 1),
        ("tar_level1_percent", f"Level 1 above range ({n(hi + 1)}-{n(hi2)} mg/dL)", "Detailed Range Bands", "%", 1), ("tar_level2_percent", f"Level 2 above range (>{n(hi2)} mg/dL)", "Detailed Range Bands", "%", 1),
        ("lbgi", "Low blood glucose index", "Risk", "index", 2), ("hbgi", "High blood glucose index", "Risk", "index", 2), ("j_index", "J-index", "Risk", "index", 2),
        ("conga_12h", "CONGA, 12 hour", "Excursions", "mg/dL", 2), ("conga_24h", "CONGA, 24 hour", "Excursions", "mg/dL", 2), ("modd", "Mean of daily differences", "Excursions", "mg/dL", 2),
        ("mage", "Mean amplitude of glycemic excursions", "Excursions", "mg/dL", 2),
    ]
    return [(*r, i + 1) for i, r in enumerate(rows)]


CATEGORY_ORDER = ("Data Coverage", "Central Tendency", "Variability", "Time in Range", "Detailed Range Bands", "Risk", "Excursions")
PERIOD_LABELS = {"full_day": "Full day", "daytime": "Daytime", "nighttime": "Nighttime"}
KEY_METRICS = ("readings", "mean_glucose", "cv_percent", "tir_percent", "tbr_percent", "tar_percent")


def metrics_long(metrics: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per subject, period and metric, rounded for display, with the columns to sort by (``category_order``, ``metric_order``)."""
    known = [r for r in catalog(thresholds) if r[0] in metrics.columns]
    keys = keys_of(metrics)
    rows = F.explode(F.array(*(
        F.struct(F.lit(raw).alias("raw_name"), F.lit(label).alias("metric"), F.lit(category).alias("category"), F.round(F.col(raw).cast("double"), digits).alias("value"), F.lit(units).alias("units"), F.lit(CATEGORY_ORDER.index(category) + 1).alias("category_order"), F.lit(order).alias("metric_order"))
        for raw, label, category, units, digits, order in known
    )))
    d = metrics.select(*keys, rows.alias("r")).select(*keys, "r.*")
    if "metric_period" in keys:
        label = F.lit("Full day")
        for name, text in PERIOD_LABELS.items():
            label = F.when(F.col("metric_period") == name, text).otherwise(label)
        d = d.withColumn("period", label)
    return d


def summary_cards(long: DataFrame) -> DataFrame:
    """The mean of the displayed values of the key metrics."""
    return long.where(F.col("raw_name").isin(*KEY_METRICS)).groupBy("raw_name", "metric", "units").agg(F.avg("value").alias("mean_value"))


def tir_long(metrics: DataFrame) -> DataFrame:
    """Below, in and above range of the full day as rows."""
    d = metrics.where(F.col("metric_period") == "full_day") if "metric_period" in metrics.columns else metrics
    keys = [k for k in keys_of(d) if k != "metric_period"]
    return d.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("range"), F.col(c).alias("percent")) for n, c in (("Below range", "tbr_percent"), ("In range", "tir_percent"), ("Above range", "tar_percent"))))).alias("r")).select(*keys, "r.*")


def agp(df: DataFrame, bin_minutes: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Glucose percentiles by time of day: bins named by their middle."""
    d = df.where(F.col("glucose").isNotNull() & F.col("timestamp").isNotNull()).withColumn("time_minutes", F.floor(minute_of_day() / bin_minutes) * bin_minutes + bin_minutes / 2)
    q = F.percentile("glucose", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    d = d.groupBy(*by, "time_minutes").agg(q.alias("q"), F.count("*").alias("n"))
    return d.select(*by, "time_minutes", *(F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "median", "q75", "q95"))), "n")


def time_of_day(df: DataFrame) -> DataFrame:
    """Readings with their date and minute of the day, for overlays."""
    return df.where(F.col("timestamp").isNotNull()).select(*[c for c in df.columns if c != "_ord"], F.to_date("timestamp").alias("date"), minute_of_day().alias("time_minutes"))


def data_signature(df: DataFrame) -> DataFrame:
    """One row that changes when the data do."""
    imputed = F.count_if("imputed_flag") if "imputed_flag" in df.columns else F.lit(0)
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("participants"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count_if(F.col("glucose").isNull()).alias("missing_glucose"), F.round(F.sum("glucose"), 4).alias("glucose_sum"), imputed.alias("imputed_rows"),
    )

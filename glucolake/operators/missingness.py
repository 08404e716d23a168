"""Missing readings: the regular grid (made or counted), gaps, daily summary, coverage calendar, comparison."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import QcParams, interval
from glucolake.functions.columns import MICROS_PER_MINUTE, micros, numbered_in_order, real_subject, with_previous
from glucolake.operators.quality import qc_summary

OBSERVED, EXPLICIT, GAP = "observed", "explicit_na", "timestamp_gap"


def with_flags(df: DataFrame) -> DataFrame:
    """Where a missing value comes from: the three source columns and ``imputed_flag``, derived where they are absent or null."""
    has = set(df.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    inserted = F.coalesce(col("inserted_timestamp_gap", "boolean"), col("missing_source", "string") == GAP, F.lit(False))
    explicit = F.coalesce(col("explicit_missing_glucose", "boolean"), col("missing_source", "string") == EXPLICIT, F.col("glucose").isNull() & ~inserted)
    d = df.withColumns({"__inserted": inserted, "__explicit": explicit, "imputed_flag": F.coalesce(col("imputed_flag", "boolean"), F.lit(False))})
    source = F.coalesce(col("missing_source", "string"), F.when(F.col("__inserted"), GAP).when(F.col("__explicit"), EXPLICIT).otherwise(OBSERVED))
    return d.withColumns({"missing_source": source, "inserted_timestamp_gap": F.col("__inserted"), "explicit_missing_glucose": F.col("__explicit")}).drop("__inserted", "__explicit")


def on_grid() -> Column:
    """Whether a row has a place on a subject's grid."""
    return real_subject() & F.col("timestamp").isNotNull()


def snapped(df: DataFrame, minutes: int) -> DataFrame:
    """Rows on the grid, one for each ``slot`` (whole steps from the subject's first reading, halves to even), readings before missing ones, then by ``_ord``."""
    d = with_flags(df).where(on_grid())
    # The first time is taken by an aggregate and joined, so a subject's rows stay spread.
    first = d.groupBy("id").agg(F.min(micros()).alias("anchor"))
    d = d.join(first, "id").withColumn("slot", F.bround((micros() - F.col("anchor")) / (minutes * MICROS_PER_MINUTE)).cast("long"))
    one = d.groupBy("id", "slot").agg(F.min_by(F.struct(*[c for c in d.columns if c not in ("id", "slot")]), F.struct(F.col("glucose").isNull(), F.col("_ord"))).alias("row"))
    return one.select("id", "slot", "row.*")


def grid_summary(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Missing readings per subject, counted without making the grid: a step of k slots hides k - 1 readings."""
    minutes = interval(minutes)
    s = with_previous(snapped(df, minutes).withColumn("__day", F.floor(F.col("slot") * minutes / 1440)), {"__slot": F.col("slot")}, order=("slot",), chunk=F.floor(F.col("slot") * minutes / 1440))
    hidden = F.coalesce(F.col("slot") - F.col("__slot") - 1, F.lit(0))
    rows = s.select("id", F.col("explicit_missing_glucose").alias("explicit"), F.col("inserted_timestamp_gap").alias("gap"), F.col("glucose").isNull().alias("missing"), hidden.alias("hidden"))
    rest = with_flags(df).where(~F.coalesce(on_grid(), F.lit(False))).select("id", F.col("explicit_missing_glucose").alias("explicit"), F.col("inserted_timestamp_gap").alias("gap"), F.col("glucose").isNull().alias("missing"), F.lit(0).cast("long").alias("hidden"))
    return _rates(rows.unionByName(rest), "id")


def _rates(rows: DataFrame, *keys: str) -> DataFrame:
    n, missing = F.count("*") + F.sum("hidden"), F.count_if("missing") + F.sum("hidden")
    return rows.groupBy(*keys).agg(
        n.alias("expanded_rows"), F.count_if("explicit").alias("explicit_missing_glucose"), (F.count_if("gap") + F.sum("hidden")).alias("estimated_missing_readings"),
        missing.alias("missing_glucose"), F.round(100 * missing / n, 2).alias("missing_glucose_rate"),
    )


def regular_grid(df: DataFrame, minutes: int = 5) -> DataFrame:
    """The grid itself: every slot between a subject's first and last, inserted rows flagged and given the metadata that is unique within the subject; rows without a place on it stay as they are.

    Slots are made between neighbours (a step of k slots makes k - 1 rows), not from one long sequence per subject.
    """
    minutes = interval(minutes)
    s = snapped(df, minutes)
    s = with_previous(s, {"__slot": F.col("slot")}, order=("slot",), chunk=F.floor(F.col("slot") * minutes / 1440))
    at = lambda slot: F.timestamp_micros(F.col("anchor") + slot * minutes * MICROS_PER_MINUTE)
    own = s.withColumn("timestamp", at(F.col("slot")))
    made = s.where(F.col("slot") - F.col("__slot") > 1).select("id", "anchor", F.explode(F.sequence(F.col("__slot") + 1, F.col("slot") - 1)).alias("slot"))
    fixed = {"id", "timestamp", "glucose", "_ord", "imputed_flag", "missing_source", "inserted_timestamp_gap", "explicit_missing_glucose", "anchor", "slot", "__slot"}
    meta = [c for c in s.columns if c not in fixed]
    unique = df.where(on_grid()).groupBy("id").agg(*(F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in meta)) if meta else df.where(on_grid()).select("id").distinct()
    made = made.withColumn("timestamp", at(F.col("slot"))).join(unique, "id").withColumns({
        "glucose": F.lit(None).cast("double"), "_ord": F.lit(None).cast("long"), "imputed_flag": F.lit(False), "missing_source": F.lit(GAP),
        "inserted_timestamp_gap": F.lit(True), "explicit_missing_glucose": F.lit(False),
    })
    columns = ["id", "slot", "timestamp", "glucose", *meta, "imputed_flag", "missing_source", "inserted_timestamp_gap", "explicit_missing_glucose", "_ord"]
    rest = with_flags(df).where(~F.coalesce(on_grid(), F.lit(False))).withColumn("slot", F.lit(None).cast("long"))
    return own.select(*columns).unionByName(made.select(*columns)).unionByName(rest.select(*columns))


def grid_summary_of(grid: DataFrame) -> DataFrame:
    """The summary of ``grid_summary`` from a grid that has been made."""
    return _rates(grid.select("id", F.col("explicit_missing_glucose").alias("explicit"), F.col("inserted_timestamp_gap").alias("gap"), F.col("glucose").isNull().alias("missing"), F.lit(0).cast("long").alias("hidden")), "id")


def gap_periods(df: DataFrame, minutes: int = 5, grid: DataFrame | None = None) -> DataFrame:
    """Runs of missing slots: first and last slot without a reading, minutes, number of readings.

    A run is bounded by rows of the grid that weren't inserted, so it is read off two neighbours,
    of ``grid`` where that has been made.
    """
    minutes = interval(minutes)
    width = minutes * MICROS_PER_MINUTE
    if grid is None:
        s = snapped(df, minutes).where(~F.col("inserted_timestamp_gap")).select("id", "slot", (F.col("anchor") + F.col("slot") * width).alias("us"))
    else:
        s = grid.where(F.col("slot").isNotNull() & ~F.col("inserted_timestamp_gap")).select("id", "slot", micros().alias("us"))
    s = with_previous(s, {"__slot": F.col("slot")}, order=("slot",), chunk=F.floor(F.col("slot") * minutes / 1440))
    step = F.col("slot") - F.col("__slot") - 1
    return s.where(step > 0).select(
        "id", F.timestamp_micros(F.col("us") - step * width).alias("gap_start"), F.timestamp_micros(F.col("us") - width).alias("gap_end"), (step * minutes).cast("double").alias("gap_minutes"),
        F.lit(float(minutes)).alias("expected_interval_minutes"), step.alias("estimated_missing_readings"),
    )


def missingness_summary(df: DataFrame, minutes: int = 5, qc: QcParams = QcParams()) -> DataFrame:
    """QC measures beside grid counts and gaps, per subject."""
    q = qc_summary(df, qc).select(
        "id", "readings", F.col("missing_glucose").alias("__missing"), "max_gap_minutes", "valid_days", "observed_days", "median_interval_minutes", "duplicate_timestamps"
    )
    g = grid_summary(df, minutes).select(F.col("id").alias("gid"), "expanded_rows", "missing_glucose", "missing_glucose_rate", "explicit_missing_glucose")
    p = gap_periods(df, minutes).groupBy(F.col("id").alias("pid")).agg(F.count("*").alias("gap_count"), F.sum("estimated_missing_readings").alias("estimated_missing_readings"))
    d = q.join(g, F.col("id").eqNullSafe(F.col("gid")), "left").join(p, F.col("id") == F.col("pid"), "left")
    return d.select(
        "id", "readings", F.coalesce("expanded_rows", "readings").alias("expanded_rows"), F.coalesce("missing_glucose", "__missing").alias("missing_glucose"), "missing_glucose_rate",
        F.coalesce("explicit_missing_glucose", "__missing").alias("explicit_missing_glucose"), F.coalesce("gap_count", F.lit(0)).alias("gap_count"), "max_gap_minutes", "valid_days",
        "observed_days", "median_interval_minutes", "duplicate_timestamps", F.coalesce("estimated_missing_readings", F.lit(0)).alias("estimated_missing_readings"),
    )


def daily_heatmap(df: DataFrame, minutes: int = 5, grid: DataFrame | None = None) -> DataFrame:
    """Per subject and day: rows read, grid rows, missing and imputed ones, gaps that begin that day."""
    gap_rows = gap_periods(df, minutes, grid)
    grid = regular_grid(df, minutes) if grid is None else grid
    day = F.to_date("timestamp").alias("date")
    g = grid.where(F.col("timestamp").isNotNull()).groupBy("id", day).agg(
        F.count("*").alias("expanded_rows"), F.count_if(F.col("glucose").isNull()).alias("missing_glucose"),
        F.round(100 * F.count_if(F.col("glucose").isNull()) / F.count("*"), 2).alias("missing_glucose_rate"),
        F.count_if("imputed_flag").alias("imputed_rows"), F.count_if("inserted_timestamp_gap").alias("estimated_missing_readings"),
    )
    raw = df.where(F.col("timestamp").isNotNull()).groupBy(F.col("id").alias("rid"), F.to_date("timestamp").alias("rdate")).agg(F.count("*").alias("readings"))
    gaps = gap_rows.groupBy(F.col("id").alias("pid"), F.to_date("gap_start").alias("pdate")).agg(F.count("*").alias("timestamp_gaps"))
    d = g.join(raw, g["id"].eqNullSafe(raw["rid"]) & (g["date"] == raw["rdate"]), "left").join(gaps, (g["id"] == gaps["pid"]) & (g["date"] == gaps["pdate"]), "left")
    d = d.select("id", "date", F.coalesce("readings", F.lit(0)).alias("readings"), "expanded_rows", "missing_glucose", "missing_glucose_rate", "imputed_rows", "estimated_missing_readings", F.coalesce("timestamp_gaps", F.lit(0)).alias("timestamp_gaps"))
    text = lambda c: F.col(c).cast("string")
    return d.withColumn("tooltip", F.concat(
        F.lit("Subject ID: "), F.coalesce("id", F.lit("")), F.lit("<br>Date: "), text("date"), F.lit("<br>Readings: "), text("readings"), F.lit("<br>Missing glucose or inferred gap readings: "), text("missing_glucose"),
        F.lit("<br>Missing glucose rate: "), text("missing_glucose_rate"), F.lit("%<br>Timestamp gaps: "), text("timestamp_gaps"),
        F.lit("<br>Inferred missing readings from timestamp gaps: "), text("estimated_missing_readings"), F.lit("<br>Imputed rows: "), text("imputed_rows"),
    ))


def coverage_status(percent: Column, readings: Column) -> Column:
    return F.when(readings.isNull() | (readings == 0) | percent.isNull(), "No data").when(percent < 50, "Low coverage (<50%)").when(percent < 80, "Partial coverage (50-79%)").otherwise("High coverage (>=80%)")


def coverage_calendar(df: DataFrame, minutes: int = 5, start: str | None = None, end: str | None = None, heatmap: DataFrame | None = None) -> DataFrame:
    """Every day between a subject's first and last, with readings, coverage and its place in a compact month layout; from ``heatmap`` where that has been made."""
    minutes = interval(minutes)
    span = df.where(on_grid()).groupBy("id").agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    if start is not None:
        span = span.withColumn("a", F.greatest("a", F.lit(start).cast("date")))
    if end is not None:
        span = span.withColumn("b", F.least("b", F.lit(end).cast("date")))
    days = span.where("a <= b").select(F.col("id").alias("sid"), F.explode(F.sequence("a", "b")).alias("day"))
    h = (daily_heatmap(df, minutes) if heatmap is None else heatmap).drop("tooltip")
    d = days.join(h, (days["sid"] == h["id"]) & (days["day"] == h["date"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    expected = float(round(1440 / minutes))
    d = d.select(F.col("sid").alias("id"), F.col("day").alias("date"), zero("readings"), zero("missing_glucose"), "missing_glucose_rate", zero("timestamp_gaps"), zero("estimated_missing_readings"), zero("imputed_rows"), F.lit(expected).alias("expected_readings"))
    d = d.withColumn("coverage_percent", F.least(F.lit(100.0), F.round(100 * F.col("readings") / expected, 1)))
    d = d.withColumn("coverage_status", coverage_status(F.col("coverage_percent"), F.col("readings")))
    d = d.withColumns({"month": F.date_format("date", "yyyy-MM"), "weekday": F.weekday("date") + 1, "week_start": F.to_date(F.date_trunc("week", "date"))})
    # Weeks are numbered within a month, months are set side by side; these tables have a row per week or month.
    weeks = d.select("month", "week_start").distinct().withColumn("week_index", F.dense_rank().over(Window.partitionBy("month").orderBy("week_start")) - 1)
    months = weeks.groupBy("month").agg((F.max("week_index") + 1).alias("wide"))
    months = months.withColumn("month_offset", F.coalesce(F.sum("wide").over(Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = numbered_in_order(span.where("a <= b").select("id"), "id", "id_index")
    d = d.join(weeks, ["month", "week_start"]).join(months.select("month", "month_offset"), "month").join(nth, "id")
    return d.withColumns({"plot_x": F.col("month_offset") + F.col("week_index"), "plot_y": (F.col("id_index") - 1) * 8 + F.col("weekday")}).drop("id_index", "week_start")


def bundle(df: DataFrame, minutes: int = 5) -> dict[str, DataFrame]:
    """Everything that a grid gives, from one grid: ``grid``, ``summary``, ``gaps``, ``heatmap``, ``calendar`` and ``warnings``.

    The grid and the heatmap are kept on the executors' disks until they are unpersisted.
    """
    grid = regular_grid(df, minutes).persist(StorageLevel.DISK_ONLY)
    heatmap = daily_heatmap(df, minutes, grid).persist(StorageLevel.DISK_ONLY)
    calendar = coverage_calendar(df, minutes, heatmap=heatmap)
    return {"grid": grid, "summary": grid_summary_of(grid), "gaps": gap_periods(df, minutes, grid), "heatmap": heatmap, "calendar": calendar, "warnings": day_warnings(calendar)}


def day_warnings(calendar: DataFrame) -> DataFrame:
    """Per subject: days without a reading, and days with less than half of the expected ones."""
    return calendar.groupBy("id").agg(F.count_if(F.col("readings") == 0).alias("full_missing_days"), F.count_if((F.col("readings") > 0) & (F.col("coverage_percent") < 50)).alias("half_day_or_worse_days"))


def compare(original: DataFrame, analysis: DataFrame, minutes: int = 5) -> DataFrame:
    """Missing readings before and after preprocessing, per subject of either table, and the readings that were filled (by id and time)."""
    a = grid_summary(original, minutes).select(F.col("id").alias("ida"), *(F.col(c).alias(f"original_{c}") for c in ("expanded_rows", "missing_glucose", "missing_glucose_rate")))
    b = grid_summary(analysis, minutes).select(F.col("id").alias("idb"), *(F.col(c).alias(f"analysis_{c}") for c in ("expanded_rows", "missing_glucose", "missing_glucose_rate")))
    filled = with_flags(analysis).where(F.col("imputed_flag") & F.col("glucose").isNotNull()).groupBy(F.col("id").alias("idf")).agg(F.count("*").alias("filled_glucose"))
    d = a.join(b, a["ida"].eqNullSafe(b["idb"]), "full_outer").withColumn("id", F.coalesce("ida", "idb"))
    d = d.join(filled, d["id"].eqNullSafe(filled["idf"]), "left").withColumn("filled_glucose", F.coalesce("filled_glucose", F.lit(0)))
    return d.withColumn("missing_change", F.col("analysis_missing_glucose") - F.col("original_missing_glucose")).drop("ida", "idb", "idf")


def severity(rate: Column) -> Column:
    return F.when(rate == 0, "No missing glucose").when(rate <= 5, "Acceptable missingness").when(rate <= 25, "Moderate missingness").otherwise("Severe missingness")


def missingness_review(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Per subject: rate and severity of missing readings, with a warning above 25 %."""
    g = grid_summary(df, minutes)
    return g.select("id", "expanded_rows", "missing_glucose", "missing_glucose_rate", severity(F.col("missing_glucose_rate")).alias("severity"), (F.col("missing_glucose_rate") > 25).alias("warn"))

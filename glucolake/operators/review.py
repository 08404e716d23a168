"""Summaries for a person to review: upload, validation, readiness, warnings, plot selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucolake.config import interval
from glucolake.functions.columns import MICROS_PER_MINUTE, micros, with_previous
from glucolake.operators.missingness import on_grid

READY, ATTENTION = "Ready", "Needs attention"


def _count(c: Column) -> Column:
    return F.format_number(c, 0)


def rows_of(df: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
    """Label and value rows of a one-row table."""
    return df.select(F.posexplode(F.array(*(F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")) for label, value in pairs)))).select(F.col("pos").alias("position"), "col.label", "col.value")


def upload_summary(df: DataFrame) -> DataFrame:
    """Files, rows, subjects and the span of dates."""
    files = F.count_distinct("source_file") if "source_file" in df.columns else F.lit(1)
    one = df.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("subjects"), files.alias("files"), F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    span = F.coalesce(F.concat_ws(" to ", F.nullif(F.col("a").cast("string"), F.lit("")), F.col("b").cast("string")), F.lit(""))
    return rows_of(one, ("Files", _count(F.col("files"))), ("Rows", _count(F.col("rows"))), ("Subjects", _count(F.col("subjects"))), ("Date span", F.when(F.col("a").isNull(), "Not available").otherwise(span)))


def timestamp_rows(summary: DataFrame) -> DataFrame:
    """A timestamp parse summary for display."""
    span = F.when(F.col("first_timestamp").isNull(), "Not available").otherwise(F.concat_ws(" to ", F.to_date("first_timestamp").cast("string"), F.to_date("last_timestamp").cast("string")))
    return rows_of(summary, ("Rows", _count(F.col("rows"))), ("Parsed timestamps", _count(F.col("parsed"))), ("Invalid timestamps", _count(F.col("failed"))), ("Ambiguous date values", _count(F.col("ambiguous"))), ("Date-only values", _count(F.col("date_only"))), ("Date span", span))


def glucose_rows(summary: DataFrame) -> DataFrame:
    """A glucose parse summary for display."""
    span = F.when(F.col("min_glucose").isNull(), "Not available").otherwise(F.format_string("%.1f to %.1f mg/dL", "min_glucose", "max_glucose"))
    return rows_of(summary, ("Rows", _count(F.col("rows"))), ("Numeric values", _count(F.col("numeric"))), ("Missing values", _count(F.col("missing"))), ("Non-numeric values", _count(F.col("non_numeric"))), ("Values outside review range", _count(F.col("implausible"))), ("Range", span))


def validation(timestamps: DataFrame, glucose: DataFrame) -> DataFrame:
    """One row per check: status and what it says; both inputs are one-row summaries."""
    both = timestamps.select(*(F.col(c).alias(f"t_{c}") for c in timestamps.columns)).crossJoin(F.broadcast(glucose.select(*(F.col(c).alias(f"g_{c}") for c in glucose.columns))))
    state = lambda good: F.when(good, READY).otherwise(ATTENTION)
    n = lambda c, text: F.concat(_count(F.col(c)), F.lit(text))
    checks = [
        ("Timestamps parse", (F.col("t_parsed") > 0) & (F.col("t_failed") == 0), n("t_failed", " invalid timestamp(s)")),
        ("Date order", F.col("t_ambiguous") == 0, n("t_ambiguous", " ambiguous date value(s)")),
        ("Times of day", F.col("t_date_only") == 0, n("t_date_only", " value(s) without a time")),
        ("Glucose is numeric", (F.col("g_numeric") > 0) & (F.col("g_non_numeric") == 0), n("g_non_numeric", " non-numeric value(s)")),
        ("Glucose is plausible", F.col("g_implausible") == 0, n("g_implausible", " value(s) outside review range")),
        ("Units", ~F.col("g_suspicious_units"), F.when(F.col("g_suspicious_units"), "Values don't look like the chosen units").otherwise("")),
    ]
    cells = F.array(*(F.struct(F.lit(name).alias("check"), state(good).alias("status"), text.alias("detail")) for name, good, text in checks))
    return both.select(F.posexplode(cells)).select(F.col("pos").alias("position"), "col.*")


def warnings_of(checks: DataFrame) -> DataFrame:
    """Warnings of the checks that need attention."""
    return checks.where(F.col("status") == ATTENTION).select("position", F.concat_ws(": ", "check", "detail").alias("warning"))


def imputation_warnings(df: DataFrame, column: str = "message") -> DataFrame:
    """Warning messages split at bars, by subject and type: missingness, block (of contiguous missing values), other."""
    text = F.regexp_replace(F.col(column), r"^.*Warnings:\s*", "")
    d = df.select(F.explode(F.split(text, r"\s*\|\s*")).alias("item")).withColumn("item", F.trim("item")).where("item <> ''")
    d = d.where(~F.lower("item").rlike(r"^(long contiguous missing glucose blocks were detected|number of logged events:|logged events:)")).distinct()
    subject = F.nullif(F.regexp_extract("item", r"^Subject (.+?)( has |:)", 1), F.lit(""))
    kind = F.when(F.lower("item").contains("contiguous missing block"), "block").when(F.lower("item").contains("missing"), "missingness").otherwise("other")
    order = F.array_position(F.array(*map(F.lit, ("missingness", "block", "other"))), kind)
    return d.select(F.coalesce(F.concat(F.lit("Subject "), subject), F.lit("Dataset warnings")).alias("group"), subject.alias("subject"), kind.alias("type"), order.cast("int").alias("type_order"), "item")


def overlay_days(df: DataFrame, most: int = 14) -> DataFrame:
    """Per subject: days with readings, and whether a legend of days is worth drawing."""
    d = df.where(F.col("timestamp").isNotNull()).groupBy("id").agg(F.count("*").alias("readings"), F.count_distinct(F.to_date("timestamp")).alias("days"))
    return d.withColumn("show_legend", F.col("days") <= most)


def regularize_series(df: DataFrame, minutes: int | None = 5, max_gap_intervals: int = 4) -> DataFrame:
    """Each subject's mean by grid slot, with the slots between two neighbours up to ``max_gap_intervals`` apart on the line between them."""
    step = interval(minutes)
    d = df.where(F.coalesce(on_grid(), F.lit(False)) & F.col("glucose").isNotNull())
    first = d.groupBy("id").agg(F.min(micros()).alias("anchor"))
    s = d.join(first, "id").groupBy("id", "anchor", F.bround((micros() - F.col("anchor")) / (step * MICROS_PER_MINUTE)).cast("long").alias("slot")).agg(F.avg("glucose").alias("glucose"))
    s = with_previous(s, {"s0": F.col("slot"), "g0": F.col("glucose")}, order=("slot",), chunk=F.floor(F.col("slot") * step / 1440))
    gap = F.col("slot") - F.col("s0")
    made = s.where((gap > 1) & (gap <= max_gap_intervals)).withColumn("at", F.explode(F.sequence(F.col("s0") + 1, F.col("slot") - 1)))
    made = made.select("id", "anchor", F.col("at").alias("slot"), (F.col("g0") + (F.col("glucose") - F.col("g0")) * (F.col("at") - F.col("s0")) / gap).alias("glucose"), F.lit(True).alias("interpolated"))
    rows = s.select("id", "anchor", "slot", "glucose", F.lit(False).alias("interpolated")).unionByName(made)
    return rows.select("id", F.timestamp_micros(F.col("anchor") + F.col("slot") * step * MICROS_PER_MINUTE).alias("timestamp"), "glucose", "interpolated")


def metric_state(df: DataFrame | None) -> str:
    """Where an analysis stands: ``needs_mapping``, ``no_analysis_rows`` or ``base_ready``."""
    if df is None or not {"id", "timestamp", "glucose"} <= set(df.columns):
        return "needs_mapping"
    return "base_ready" if df.limit(1).count() else "no_analysis_rows"


def guess_columns(names: list[str]) -> dict[str, str]:
    """Metadata columns by their names: group, sex, age, hba1c (fixed patterns)."""
    import re

    patterns = {"group": r"^(group|arm|treatment|cohort)$", "sex": r"^(sex|gender)$", "age": r"^age(_?years)?$", "hba1c": r"^(hb)?_?a1c$"}
    found = {}
    for key, pattern in patterns.items():
        hit = next((n for n in names if re.search(pattern, n.strip().lower())), None)
        if hit:
            found[key] = hit
    return found


def top_review(review: DataFrame, n: int = 8) -> DataFrame:
    """The subjects to look at first: most gaps, then most missing readings."""
    return review.where(F.col("qc_status") == "Review").orderBy(F.desc_nulls_last("gap_count"), F.desc_nulls_last("missing_glucose"), "id").limit(n)


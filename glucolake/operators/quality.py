"""Quality control of readings: sampling interval, gaps, wear time, duplicates, implausible values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.config import QcParams
from glucolake.functions.columns import MICROS_PER_MINUTE, micros, with_previous


def intervals(df: DataFrame) -> DataFrame:
    """Rows with a timestamp and the minutes since the subject's row before (``gap_minutes``)."""
    d = with_previous(df.where(F.col("timestamp").isNotNull()), {"__ts": micros()})
    return d.withColumn("gap_minutes", (micros() - F.col("__ts")) / MICROS_PER_MINUTE).drop("__ts")


def median_interval(df: DataFrame) -> DataFrame:
    """``id``, ``median_interval_minutes``: the median of gaps above 0, null below two distinct times."""
    return intervals(df).groupBy("id").agg(F.percentile(F.when(F.col("gap_minutes") > 0, F.col("gap_minutes")), 0.5).alias("median_interval_minutes"))


def qc_summary(df: DataFrame, params: QcParams = QcParams()) -> DataFrame:
    """Twelve measures per subject.

    Rows are counted once, by day and length of the gap before them; everything else, the
    median interval with which gaps are compared too, follows from these counts.
    """
    low, high = params.glucose_min, params.glucose_max
    placed = intervals(df).select("id", F.to_date("timestamp").alias("day"), "gap_minutes", "timestamp", "glucose")
    loose = df.where(F.col("timestamp").isNull()).select("id", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("gap_minutes"), "timestamp", "glucose")
    counts = placed.unionByName(loose).groupBy("id", "day", "gap_minutes").agg(
        F.count("*").alias("n"), F.count("glucose").alias("observed"), F.count_if((F.col("glucose") < low) | (F.col("glucose") > high)).alias("implausible"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )
    by_length = counts.groupBy("id", "gap_minutes").agg(F.sum("n").alias("n"))
    median = by_length.groupBy("id").agg(F.percentile(F.when(F.col("gap_minutes") > 0, F.col("gap_minutes")), 0.5, F.col("n")).alias("median_interval_minutes")).withColumnRenamed("id", "median_id")
    counted = (
        by_length.join(median, F.col("id").eqNullSafe(F.col("median_id"))).groupBy(F.col("id").alias("gap_id"), "median_interval_minutes")
        .agg(
            F.when(F.col("median_interval_minutes").isNotNull(), F.coalesce(F.sum(F.when(F.col("gap_minutes") > params.gap_factor * F.col("median_interval_minutes"), F.col("n"))), F.lit(0))).alias("gap_count"),
            F.max("gap_minutes").alias("max_gap_minutes"),
        )
    )
    # A row without a gap before it repeats a time; a subject's first row has none either, but its gap is null.
    days = counts.groupBy("id", "day").agg(
        F.sum("n").alias("rows"), F.sum("observed").alias("observed"), F.sum("implausible").alias("implausible"), F.coalesce(F.sum(F.when(F.col("gap_minutes") == 0, F.col("n"))), F.lit(0)).alias("again"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    whole = days.groupBy("id").agg(
        F.sum("rows").alias("readings"), F.min("first").alias("first_timestamp"), F.max("last").alias("last_timestamp"), F.sum("observed").alias("observed"),
        (F.sum("rows") - F.sum("observed")).alias("missing_glucose"), F.sum("implausible").alias("implausible_values"), F.count("day").alias("observed_days"),
        F.collect_list(F.when(F.col("day").isNotNull(), F.col("rows"))).alias("day_rows"), F.sum("again").alias("duplicate_timestamps"),
    )
    d = whole.join(counted, F.col("id").eqNullSafe(F.col("gap_id")), "left")
    span = (micros("last_timestamp") - micros("first_timestamp")) / MICROS_PER_MINUTE
    wear = 100 * F.col("observed") / (F.floor(span / F.col("median_interval_minutes")) + 1)
    return d.select(
        "id", "readings", "first_timestamp", "last_timestamp", "observed_days",
        F.when(F.col("median_interval_minutes").isNotNull(), F.size(F.filter("day_rows", lambda n: n * F.col("median_interval_minutes") / 60 >= params.valid_day_hours))).cast("long").alias("valid_days"),
        "median_interval_minutes", wear.alias("wear_time_percent"), "missing_glucose", "duplicate_timestamps",
        "implausible_values", "gap_count", "max_gap_minutes",
    )


def qc_review(summary: DataFrame, low_coverage_percent: int = 80) -> DataFrame:
    """``qc_summary`` with ``qc_status`` (OK or Review) and ``review_notes``, in front."""
    note = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    notes = F.concat_ws(
        "; ", note("missing_glucose", " missing glucose row(s)"), note("gap_count", " timestamp gap(s)"), note("duplicate_timestamps", " duplicate timestamp(s)"),
        note("implausible_values", " glucose value(s) outside review range"), F.when(F.col("valid_days") == 0, "No valid CGM days"),
        F.when(F.col("wear_time_percent") < low_coverage_percent, f"Coverage below {low_coverage_percent}%"),
    )
    rest = [c for c in summary.columns if c != "id"]
    d = summary.withColumn("__notes", notes)
    return d.select("id", F.when(F.col("__notes") == "", "OK").otherwise("Review").alias("qc_status"), F.when(F.col("__notes") == "", "No review flags").otherwise(F.col("__notes")).alias("review_notes"), *rest)


def duplicate_totals(summary: DataFrame) -> DataFrame:
    """One row: duplicate timestamps in all and the subjects that have some."""
    return summary.agg(F.coalesce(F.sum("duplicate_timestamps"), F.lit(0)).alias("duplicate_timestamps"), F.count_if(F.col("duplicate_timestamps") > 0).alias("affected_subjects"))


def duplicate_note(summary: DataFrame, show_subjects: bool = True) -> DataFrame:
    """The totals with what is told of them; no row where no timestamp is there twice."""
    across = F.concat(F.lit(" across "), F.format_number("affected_subjects", 0), F.lit(" Subject ID(s)")) if show_subjects else F.lit("")
    message = F.concat(F.format_number("duplicate_timestamps", 0), F.lit(" duplicate timestamp(s) detected"), across, F.lit(". Review duplicate timestamps before final analysis if they are unexpected."))
    return duplicate_totals(summary).where("duplicate_timestamps > 0").withColumn("message", message)


def qc_cards(summary: DataFrame, low_coverage_percent: int = 80) -> DataFrame:
    """One row of totals over all subjects."""
    return summary.agg(
        F.count("*").alias("subjects"), F.sum("readings").alias("readings"), F.sum("missing_glucose").alias("missing_glucose"), F.avg("wear_time_percent").alias("mean_wear_time_percent"),
        F.count_if(F.col("wear_time_percent") < low_coverage_percent).alias("low_coverage_subjects"), F.sum("gap_count").alias("gap_count"), F.sum("implausible_values").alias("implausible_values"),
    )

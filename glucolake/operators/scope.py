"""Which rows an analysis is about: date ranges, times of day, subjects; the observed study window."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.functions.columns import is_daytime, real_subject

WINDOW_NAMES = {
    "full_day": "full_day", "full day": "full_day", "all": "full_day", "all day": "full_day",
    "daytime": "daytime", "day": "daytime", "nighttime": "nighttime", "night": "nighttime", "overnight": "nighttime",
}


def time_window(name: str | None) -> str:
    """A window's name; unknown ones are the full day."""
    return WINDOW_NAMES.get((name or "").strip().lower().replace("_", " "), WINDOW_NAMES.get((name or "").strip().lower(), "full_day"))


def available_dates(df: DataFrame) -> DataFrame:
    """One row: the first and last date with a reading."""
    return df.agg(F.min(F.to_date("timestamp")).alias("first_date"), F.max(F.to_date("timestamp")).alias("last_date"))


def filter_dates(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows of the dates from start to end, both included; a reversed range is turned round, an open end has no limit.

    Without any limit all rows stay, also those without a timestamp.
    """
    if start is None and end is None:
        return df
    if start is not None and end is not None and str(end) < str(start):
        start, end = end, start
    day = F.to_date("timestamp")
    if start is not None:
        df = df.where(day >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(str(end)).cast("date"))
    return df


def filter_time_window(df: DataFrame, window: str = "full_day") -> DataFrame:
    """Rows of a time of day; the full day keeps rows without a timestamp, the others don't."""
    window = time_window(window)
    if window == "full_day":
        return df
    return df.where(is_daytime() if window == "daytime" else ~is_daytime())


def filter_values(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted value, or one of a list; None and 'all' mean any."""
    for column, value in wanted.items():
        values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
        if values and not any(str(v).lower() == "all" for v in values):
            df = df.where(F.col(column).cast("string").isin([str(v) for v in values]))
    return df


def study_window(df: DataFrame, expected_days: int | None = None) -> DataFrame:
    """Per subject: first and last date, observed span in days, shortfall against an expected duration, status."""
    days = df.where(real_subject() & F.col("timestamp").isNotNull()).groupBy("id").agg(F.min(F.to_date("timestamp")).alias("first_date"), F.max(F.to_date("timestamp")).alias("last_date"))
    days = days.withColumn("observed_days", F.datediff("last_date", "first_date") + 1)
    if expected_days is None or expected_days <= 0:
        return days.withColumns({"expected_days": F.lit(None).cast("int"), "shortfall_days": F.lit(None).cast("int"), "status": F.lit("No expected duration set")})
    days = days.withColumn("expected_days", F.lit(int(expected_days))).withColumn("shortfall_days", F.greatest(F.lit(0), F.col("expected_days") - F.col("observed_days")))
    return days.withColumn("status", F.when(F.col("shortfall_days") > 0, "Short observed span").otherwise("Complete observed span"))


def show_subject_id(df: DataFrame) -> bool:
    """Subject ids are worth showing unless there is one only and it comes from a file's name."""
    seen = df.where(real_subject()).select("id", *(["id_source"] if "id_source" in df.columns else [])).distinct().limit(2).collect()
    return not (len(seen) == 1 and "id_source" in df.columns and seen[0]["id_source"] == "filename")

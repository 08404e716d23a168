"""What leaves the library: projections, files, plot manifests and file names."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucolake.config import PredictiveParams, Settings, Thresholds
from glucolake.operators import complexity as cx
from glucolake.operators import functional as fx
from glucolake.operators import metrics as mx
from glucolake.operators import predictive as px

PLOT_TYPES = ("trace", "daily-overlay", "agp", "time-in-range")


def analysis_data(df: DataFrame) -> DataFrame:
    """The standardized table with timestamps as ISO text."""
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).drop("_ord")


def complete_metrics(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """All subjects' metrics as display rows."""
    return mx.metrics_long(mx.core_metrics(df, thresholds), thresholds)


def complete_complexity(df: DataFrame) -> DataFrame:
    """Scalars and curves in one schema, with the time basis of each subject's series."""
    m = cx.complexity_metrics(df)
    modes = cx.series_modes(df).select(F.col("id").alias("__id"), cx.by_mode(cx.TIME_BASES).alias("time_basis"))
    scalar = m.select("id", F.lit("scalar").alias("row_type"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), (F.concat("note", f"{c}_note") if c in cx.NAMED else F.col("note")).alias("note")) for c in ("shannon_entropy", "hurst", "dfa_alpha", "higuchi_fd")))).alias("r"))
    scalar = scalar.select("id", "row_type", "r.metric", F.lit(None).cast("double").alias("scale_value"), "r.value", "r.note")
    curve = cx.complexity_curves(df).select("id", F.lit("curve").alias("row_type"), F.col("curve").alias("metric"), "scale_value", F.col("metric_value").alias("value"), F.lit("").alias("note"))
    return scalar.unionByName(curve).join(modes, F.col("id") == F.col("__id"), "left").drop("__id")


def complete_functional(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and curves."""
    b = fx.profile_bundle(df)
    return b["features"], b["subject_curves"]


def complete_predictive(examples: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, performance and importances of every subject's own model."""
    scores, importance = px.per_subject_models(examples, params)
    perf = px.performance(scores, params.normalized().threshold, by=("id",))
    return px.scores_export(scores, params, thresholds), px.performance_export(perf, params, thresholds), px.importance_export(importance, params, thresholds)


def status_rows(results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every subject, with its group where there is one, and whether it has results: ``Generated`` or ``Not generated``."""
    done = results.select(F.col("id").alias("did")).distinct()
    group = [F.max("group").alias("group")] if "group" in subjects.columns else []
    every = subjects.groupBy("id").agg(F.count("*").alias("__n"), *group).drop("__n")
    return every.join(done, F.col("id").eqNullSafe(F.col("did")), "left").withColumn("status", F.when(F.col("did").isNotNull(), "Generated").otherwise("Not generated")).drop("did")


def _with_status(rows: DataFrame, subjects: DataFrame, what: str) -> DataFrame:
    status = status_rows(rows, subjects).withColumns({"category": F.lit("Cache status"), "metric": F.lit(f"{what} cache status"), "definition": F.lit(f"Selected-on-demand {what} cache coverage at export time.")})
    return rows.unionByName(status, allowMissingColumns=True)


def cached_metrics(metrics: DataFrame, subjects: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Display rows of the metrics that there are, and a row for each subject of the table that tells whether it is among them."""
    return _with_status(mx.metrics_long(metrics, thresholds), subjects, "Metrics")


def cached_complexity(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """The same for rows of ``complete_complexity``."""
    return _with_status(rows, subjects, "Complexity")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; a single file only where asked for, as it passes through one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_settings(settings: Settings, path: str, spark) -> None:
    spark.createDataFrame([(settings.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def filename_part(c: Column | str) -> Column:
    """Lower case, everything but letters, digits, - and _ as one dash, no dashes at the ends; ``all`` if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^-+|-+$", ""), F.lit("")), F.lit("all"))


def plot_manifest(df: DataFrame, plot_types: tuple[str, ...] = PLOT_TYPES, extension: str = "png") -> DataFrame:
    """One row per subject and plot type, with the file's name."""
    ids = df.where(F.col("id").isNotNull()).select("id").distinct()
    d = ids.withColumn("plot_type", F.explode(F.array(*map(F.lit, plot_types))))
    return d.withColumn("file_name", F.concat(F.concat_ws("-", F.lit("cgm"), filename_part("plot_type"), filename_part("id")), F.lit(f".{extension}")))


def source_id(filename: str) -> str:
    """A file's base name without its last extension."""
    return re.sub(r"\.[^.]*$", "", PurePosixPath(filename.replace("\\", "/")).name)

"""A Spark session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_or_create(app: str = "glucolake", **conf: str) -> SparkSession:
    """Timestamps in UTC, adaptive execution with skew joins; ``conf`` has the rest (keys with dots)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

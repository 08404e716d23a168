"""Readings made from the driver's ``events`` table: the same projection in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """Standardized readings; dense: five subjects, else one per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id") % 5 if dense else F.col("user_id")
    return e.select(
        F.concat(F.lit("S" if dense else "U"), u.cast("string")).alias("id"), F.lit("mapped_column").alias("id_source"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") != "error", 40 + F.col("value")).alias("glucose"), F.lit("mg/dL").alias("units"), F.lit(False).alias("imputed_flag"),
        F.when(u % 2 == 0, "Control").otherwise("Treatment").alias("group"), F.when(u % 3 == 0, "F").otherwise("M").alias("sex"), F.col("event_id").alias("_ord"),
    )


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a device would export them: timestamps in several formats, glucose with thousands separators."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    text = lambda f: F.date_format(ts, f)
    raw = F.when(k == 0, text("yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, text("yyyy:MM:dd:HH:mm:ss")).when(k == 2, text("dd/MM/yyyy HH:mm")).when(k == 3, text("yyyy-MM-dd")).otherwise("junk")
    return e.select("event_id", raw.alias("timestamp_text"), F.when(k == 4, "n/a").otherwise(F.concat(F.lit("1,"), F.format_string("%03d", (F.col("event_id") % 1000).cast("int")))).alias("glucose_text"), F.col("event_id").alias("_ord"))


def _sql(dense: bool) -> str:
    u, letter = ("(user_id % 5)", "S") if dense else ("user_id", "U")
    return f"""g AS (SELECT '{letter}' || {u} AS id, 'mapped_column' AS id_source, ts AS timestamp, CASE WHEN event_type <> 'error' THEN 40 + value END AS glucose,
 CASE WHEN {u} % 2 = 0 THEN 'Control' ELSE 'Treatment' END AS "group", CASE WHEN {u} % 3 = 0 THEN 'F' ELSE 'M' END AS sex, event_id AS _ord,
 epoch_us(ts) AS us, hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60 AS mod FROM events)"""


DENSE, SPARSE = _sql(True), _sql(False)
TEXT = """x AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y:%m:%d:%H:%M:%S') WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M')
 WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'junk' END AS timestamp_text, CASE WHEN event_id % 5 = 4 THEN 'n/a' ELSE '1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS glucose_text FROM events)"""


def plain(df: DataFrame) -> DataFrame:
    """Columns in forms that any engine prints alike: doubles to six decimals, whole numbers as long, times and dates as text."""
    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "double":
            return F.round(c, 6)
        if kind in ("int", "smallint", "tinyint", "bigint"):
            return c.cast("long")
        if kind == "timestamp":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.cast("string") if kind == "date" else c

    return df.select(*(of(n, k).alias(n) for n, k in df.dtypes))


def plain_sql(query: str, columns: str) -> str:
    """The same for a SQL query; ``columns`` are name:kind with d, i, s, t (time), D (date), b."""
    form = {"d": "round(CAST({0} AS DOUBLE), 6)", "i": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "D": "CAST(CAST({0} AS DATE) AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
    parts = [c.split(":") for c in columns.split()]
    body = ", ".join(f'{form[k].format(chr(34) + n + chr(34))} AS "{n}"' for n, k in parts)
    head, _, tail = query.rpartition("\nFINAL ")
    return f"{head}\nSELECT {body} FROM ({tail}) AS q" if head else f"SELECT {body} FROM ({query}) AS q"

"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import DAYTIME_START_MINUTE
from glucolake.functions.tables import stored

MICROS_PER_MINUTE = 60_000_000


def micros(ts: Column | str = "timestamp") -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts if isinstance(ts, Column) else F.col(ts))


def minute_of_day(ts: Column | str = "timestamp") -> Column:
    """Minutes since midnight, with seconds as a fraction."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60


def is_daytime(ts: Column | str = "timestamp") -> Column:
    return minute_of_day(ts) >= DAYTIME_START_MINUTE


def percent(condition: Column, of: Column) -> Column:
    """Share of rows of ``of`` (not null) for which the condition holds, in percent; null without rows."""
    return 100 * F.count_if(condition) / F.nullif(F.count(of), F.lit(0))


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def real_subject(c: Column | str = "id") -> Column:
    """Whether a subject id is neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def with_bucket(d: DataFrame, value: str, edges: list, name: str) -> DataFrame:
    """``d`` with the number of ``edges``, which rise, that are at most the column ``value`` (looked up by binary search, as doubles)."""
    from pyspark.ml.feature import Bucketizer

    splits = sorted({float(e) for e in edges})
    if not splits:
        return d.withColumn(name, F.lit(0))
    return Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol=value, outputCol=name, handleInvalid="keep").transform(d).withColumn(name, F.col(name).cast("int"))


def with_sum_below(counts: DataFrame, value: str, n: str, by: tuple[str, ...] = (), buckets: int = 256, store: bool = True) -> DataFrame:
    """``counts`` with ``below``: the sum of ``n`` over the rows of ``by`` with a smaller ``value`` (a whole number or double, once for each of ``by``).

    Values are cut into buckets at approximate quantiles.  Sums run over buckets, of which there
    are few, and over the rows of a bucket, so no task has to order all values.  ``counts`` is
    stored first, as it is read three times, unless ``store`` says that it is cheap to make.
    """
    counts = stored(counts, "counts") if store else counts
    edges = sorted(set(counts.select(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []))
    d = with_bucket(counts, value, edges, "__bucket")
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "__bucket").agg(F.sum(n).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(upto(*(by or (F.lit(1),))).orderBy("__bucket")), F.lit(0)))
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__bucket").alias("__at"), "__before")
    same = F.col("__bucket") == F.col("__at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = d.join(sums, same).withColumn("below", F.col("__before") + F.coalesce(F.sum(n).over(upto(*by, "__bucket").orderBy(value)), F.lit(0)))
    return out.drop("__bucket", "__at", "__before", *(f"__{c}" for c in by))


def numbered_in_order(keys: DataFrame, key: str, name: str) -> DataFrame:
    """``keys`` (each ``key`` once, no other columns) with its place in order, from 1: sorted by ranges, numbered within each, and what comes before added from a row a range."""
    placed = stored(keys.orderBy(key).withColumn("__range", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__range").alias("__at"), (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__range")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return placed.withColumn("__nth", nth).join(before, F.col("__range") == F.col("__at")).select(key, (F.col("__before") + F.col("__nth")).alias(name))


def with_previous(df: DataFrame, columns: dict[str, Column], order: tuple[str, ...] = ("timestamp", "_ord"), key: str = "id", chunk: Column | None = None, second: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the values that ``columns`` have in the key's row before, null in its first.

    ``second`` gives for some of ``columns`` the name of a column with the value two rows before.
    The rows of a key are taken in the order of ``order``, whose first column is a timestamp;
    they are worked on by key and day, so the readings of one key never have to meet in one
    task.  Only the last rows of a key's day are carried over to the next.
    """
    chunk = F.to_date(order[0]) if chunk is None else chunk
    d = df.withColumns({"__day": chunk, "__now": F.struct(*(c.alias(n) for n, c in columns.items()))})
    by_day = Window.partitionBy(key, "__day").orderBy(*order)
    d = d.withColumn("__before", F.lag("__now").over(by_day))
    if second:
        d = d.withColumn("__earlier", F.lag("__now", 2).over(by_day))
    last = d.groupBy(key, "__day").agg(F.max_by(F.struct("__now", "__before"), F.struct(*order)).alias("__last"))
    days = Window.partitionBy(key).orderBy("__day")
    last = last.withColumns({"__carry": F.lag("__last").over(days), "__far": F.lag("__last", 2).over(days)}).drop("__last")
    last = last.select(F.col(key).alias("__key"), F.col("__day").alias("__at"), "__carry", "__far")
    d = d.join(last, d[key].eqNullSafe(last["__key"]) & d["__day"].eqNullSafe(last["__at"]), "left")
    before = F.coalesce("__before", "__carry.__now")
    out = {n: before[n] for n in columns}
    if second:
        # The second row of a day has the last row carried over before its first; the first has the two last ones.
        earlier = F.coalesce("__earlier", F.when(F.col("__before").isNotNull(), F.col("__carry.__now")).otherwise(F.coalesce("__carry.__before", "__far.__now")))
        out |= {name: earlier[n] for n, name in second.items()}
    return d.withColumns(out).drop("__day", "__now", "__before", "__earlier", "__key", "__at", "__carry", "__far")

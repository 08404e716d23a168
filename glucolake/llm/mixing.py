"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its weight's share of the wanted total, at most ``MAX_COPIES``
times its size, the excess shared again by weight until none is above.  A document's expected
copies are in proportion to the binary digits of its size (longer texts somewhat more often
than shorter ones), at most ``MAX_COPIES``, scaled so that a source's expected words are its
target.  The whole part is certain copies.  The fraction left over is the inclusion
probability p of a further copy, which differs from document to document; documents are ranked
by u / (1 - u) over p / (1 - p), u a number in (0, 1) fixed by the document's id, and taken
from the lowest rank until the source's words are as near the rest as whole documents allow
(a sample of fixed size in words).

The running sum by rank never gathers a source in one task: ranks fall into ``BINS`` bins
whose sums are added up; only rows of the bin in which the rest ends are ordered singly.

Null texts have no words; texts of a source without any words are taken once; a null source is a source, last in order; an empty table gives an
empty result.  Rows with equal ids are ranked together by size.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.llm.shared import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_COPIES, BINS, SEED = 1.5, 2, 4096, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by the id: 52 bits of an MD5."""
    text = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: ``source_size``, ``target``; from rows with ``source`` and ``size``.

    Windows here run over one row per source.
    """
    every = Window.partitionBy(F.lit(1))
    t = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    t = t.withColumn("nth", F.row_number().over(every.orderBy(F.col(source).asc_nulls_last())))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    upto = every.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    t = t.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    # Sources are capped in the order of cap / weight; the first that is not sets the level for the rest.
    t = t.withColumn("final", F.max(F.when(F.col("open"), F.struct(-F.col("cap") / F.col("weight"), -F.col("nth"), F.col("level")))).over(every)["level"])
    return t.select(source, "source_size", F.when(F.col("open"), F.least("cap", F.col("final") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source and number of binary digits: certain copies ``whole``, inclusion probability ``p`` of one more, and ``rest``, the source's words to draw.

    ``sizes`` has ``__source``, ``__digits`` and ``size``.  Copies are min(max_copies, level * digits):
    classes are capped from the longest on, and the first that stays below sets the level.
    Windows here run over one row per source and class (at most 64 of a source).
    """
    t = sizes.groupBy("__source", "__digits").agg(F.sum("size").alias("__words"))
    t = t.join(targets.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    longer = Window.partitionBy("__source").orderBy(F.desc("__digits")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__source").orderBy("__digits").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("__source")
    t = t.withColumn("__level", F.try_divide(F.col("target") - max_copies * F.coalesce(F.sum("__words").over(longer), F.lit(0)), F.sum(F.col("__words") * F.col("__digits")).over(upto)))
    t = t.withColumn("__level", F.max(F.when(F.col("__level") * F.col("__digits") <= max_copies, F.struct("__digits", "__level"))).over(every))
    copies = F.when((F.col("__digits") <= F.col("__level.__digits")) & F.col("__level.__level").isNotNull(), F.least(F.lit(float(max_copies)), F.col("__level.__level") * F.col("__digits"))).otherwise(F.lit(float(max_copies)))
    copies = F.when(F.col("source_size") == 0, 1.0).otherwise(copies)  # a source without words has nothing to weigh
    t = t.withColumn("__whole", F.floor(copies).cast("long")).withColumn("__p", copies - F.col("__whole"))
    return t.select("__source", "__digits", "source_size", "target", "__whole", "__p", (F.col("target") - F.sum(F.col("__whole") * F.col("__words")).over(every)).alias("__rest"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: str = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (= copies * size), beside the columns of ``also``."""
    d = docs.select(F.col(id_column).alias("__id"), F.col(source_column).alias("__source"), word_count(F.col(text_column)).alias("size"), *also)
    d = written(d.withColumn("__u", uniform(F.col("__id"), seed)).withColumn("__digits", F.length(F.bin("size"))), "sizes")
    plan = expected_copies(d, source_targets(d, "__source", weights, share, max_copies), max_copies)
    # Rows for each source: Spark broadcasts them if their size is below the limit.
    plan = written(plan.select(F.col("__source").alias("__of"), F.col("__digits").alias("__class"), "source_size", "target", "__whole", "__p", "__rest"), "copies")
    d = d.join(plan, d["__source"].eqNullSafe(plan["__of"]) & (d["__digits"] == plan["__class"]), "left").drop("__of", "__class")
    d = d.withColumn("__rank", F.when(F.col("__p") > 0, F.col("__u") / (1 - F.col("__u")) / (F.col("__p") / (1 - F.col("__p")))))
    d = d.withColumn("__bin", F.floor((1 - 1 / (1 + F.col("__rank"))) * BINS).cast("int"))
    # For each source: the bin in which the running sum passes the rest, and the sum before it.
    h = d.where("__bin is not null").groupBy("__source", "__bin").agg(F.sum("size").alias("__in"), F.first("__rest").alias("__rest"))
    h = h.withColumn("__before", F.sum("__in").over(Window.partitionBy("__source").orderBy("__bin")) - F.col("__in"))
    h = h.where(F.col("__before") + F.col("__in") > F.col("__rest")).groupBy(F.col("__source").alias("__s")).agg(F.min(F.struct("__bin", "__before")).alias("__edge"))
    h = written(h, "edges")  # a row for each source
    d = d.join(h, d["__source"].eqNullSafe(h["__s"]), "left").drop("__s")
    at_edge = F.coalesce(F.col("__bin") == F.col("__edge.__bin"), F.lit(False))
    order = Window.partitionBy("__source", "__bin").orderBy("__rank", F.col("__id").asc_nulls_first(), "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where(at_edge).withColumn("__sum", F.col("__edge.__before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("__more", (F.col("__sum") + F.col("size") / 2 <= F.col("__rest")).cast("long")).drop("__sum")
    below = F.coalesce(F.col("__edge").isNull() | (F.col("__bin") < F.col("__edge.__bin")), F.lit(False)) & F.col("__bin").isNotNull()
    rest = d.where(~at_edge).withColumn("__more", (below & (F.col("__rest") > 0)).cast("long"))
    out = rest.unionByName(edge).withColumn("copies", F.col("__whole") + F.col("__more"))
    return out.select(F.col("__id").alias(id_column), F.col("__source").alias(source_column), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *also)

"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet
and read again as the next one's docs.  A stage decides on rows, by a key it gives them
itself: ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucolake.llm import bpe, exact_dedup, mixing, ngram_join, quality
from glucolake.llm.queries import table, tokenizer_file
from glucolake.llm.shared import written


def free(name: str, docs: DataFrame) -> str:
    """A column name like this that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Files up to which a table's rows are numbered by file and place; a path and its number are some 200 bytes, so 20 MB are broadcast at most.
MOST_FILES = 100_000


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row that all readers see the same, and the key's name: its file's number and its place there.

    What isn't a bare table of files is written first.  Rows of more than ``MOST_FILES`` files are written with a key of their own.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "rows")
    spark = docs.sparkSession
    row, path, at, file, nth = (free(f"__{c}", docs) for c in ("row", "path", "at", "file", "nth"))
    place = docs.metadataColumn("_metadata")  # also where the documents have a column of that name
    rows = docs.select(*(docs[f"`{c}`"] for c in docs.columns), place["file_path"].alias(path), place["row_index"].alias(at))
    paths = [r[0] for r in rows.select(path).distinct().limit(MOST_FILES + 1).collect()]
    if len(paths) > MOST_FILES:
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
    files = spark.createDataFrame([(p, k) for k, p in enumerate(sorted(paths), 1)], f"`{file}` string, `{nth}` long")
    return rows.join(F.broadcast(files), F.col(path) == F.col(file)).select(*docs.columns, (F.shiftleft(F.col(nth), 40) + F.col(at)).alias(row)), row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; a null ``lang`` is a stratum of its own; rows that
    repeat share their fate; an empty table stays empty.
    """
    rows, row = with_key(docs)
    return exact_dedup.keep_rows(rows, quality.quality_rules(rows, table(spark, sf_dir, "labels"), also=(row,)), row).drop(row)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) one row stays, that of the largest id.

    Null texts equal empty ones; a null id is the smallest; of rows with the same text and id one
    stays; an empty table stays empty.
    """
    rows, row = with_key(docs)
    return exact_dedup.keep_rows(rows, exact_dedup.exact_groups(rows, row_column=row), row).drop(row)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least id stays.

    Null ids rank last, equal ids by their place in the table; null and empty texts are in no
    group and stay; an empty table stays empty.
    """
    rows, row = with_key(docs)
    groups = ngram_join.jaccard_components(rows.select(F.col(row).alias("of"), "text"), "of")
    ranked = rows.select(F.col(row).alias("row"), "doc_id").join(groups, F.col("row") == F.col("of"))
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"))
    return exact_dedup.keep_rows(rows, first.select(F.col("first.row").alias(row), F.lit(True).alias("kept")), row).drop(row)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows of one id, or of none, are drawn by their texts as well; a null source is a source; a
    text without words weighs nothing; an empty table stays empty.
    """
    rows, row = with_key(docs)
    drawn = rows.select(F.col(row).alias("row"), "text", "source", F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    of, times, copy = (free(f"__{c}", rows) for c in ("of", "times", "copy"))
    copies = mixing.mix(drawn, "key", also=("row",)).where("copies > 0").select(F.col("row").alias(of), F.col("copies").cast("int").alias(times))
    return rows.join(copies, F.col(row) == F.col(of)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's whole text, with their count and digests; a null text has none, an empty table gives no row."""
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_join", ngram_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

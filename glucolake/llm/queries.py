"""The contracted queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucolake.llm import bpe, exact_dedup, hard_negatives, html_extract, langid, mixing, ngram_join, packing, quality, sharding, spelling, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file(), keep_ids=False)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def fold(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(id_.cast("string").cast("binary")) % n


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.predict(docs, net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op6 alone, which SQL can say."""
    return quality.measures(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sharding_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of op9's shards, as counts: rows and bytes that they have in all, groups of equal texts in more than one, and shards whose slots have gaps."""
    rows = op9_sharding(spark, sf_dir)
    groups = rows.groupBy("size", "text_crc32").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_distinct("shard").alias("shards"))
    slots = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.min("slot").alias("first"))
    gaps = slots.agg(F.count_if((F.col("slots") != F.col("n")) | (F.col("last") != F.col("n") - 1) | (F.col("first") != 0)).alias("gaps"), F.max("shard").alias("last_shard"))
    whole = groups.agg(F.sum("n").alias("documents"), F.sum("bytes").alias("total_size"), F.count_if(F.col("shards") > 1).alias("split_groups"))
    return whole.join(gaps, F.lit(True)).select("documents", "total_size", "split_groups", "gaps", (F.col("last_shard") < 40).alias("in_range"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda id_: fold(id_, 5) != 0)
    return toxicity.scored(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(table(spark, sf_dir, "documents"), change=spelling.garbled))


#: Size of a text in words, and a number in (0, 1) fixed by its id, as the mixing operator has them.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((nth - 1) % 3 + 1)::INT] AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER upto, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS level
      FROM w WINDOW upto AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, cap / weight * 1000000 + nth) FROM c WHERE cap > level * weight) AS final FROM c),
t AS (SELECT source, source_size, CASE WHEN cap > level * weight THEN least(cap, final * weight) ELSE cap END AS target FROM f),
k AS (SELECT d.source, length(bin(d.size)) AS digits, CAST(sum(d.size) AS BIGINT) AS words, any_value(t.target) AS target, any_value(t.source_size) AS source_size
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, length(bin(d.size))),
l AS (SELECT *, (target - 2 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / CAST(sum(words * digits) OVER (PARTITION BY source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS level FROM k),
m AS (SELECT *, max(CASE WHEN level * digits <= 2 THEN digits END) OVER (PARTITION BY source) AS top,
             arg_max(level, digits) FILTER (WHERE level * digits <= 2) OVER (PARTITION BY source) AS scale FROM l),
p AS (SELECT *, CASE WHEN digits <= top THEN least(2.0::DOUBLE, scale * digits) ELSE 2.0::DOUBLE END AS copies FROM m),
r AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS odds,
             target - sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS rest FROM p),
q AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, r.rest, CASE WHEN r.odds > 0 THEN d.u / (1 - d.u) / (r.odds / (1 - r.odds)) END AS pareto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND length(bin(d.size)) = r.digits),
j AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, pareto IS NULL ORDER BY pareto, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN pareto IS NOT NULL AND rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j
"""

#: A group of five hexadecimal digits of the SHA-1 is four characters of base32.
OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(x, CAST(1 + (i // 4) * 5 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

#: Shingles as text; a shorter text's whole sequence has fewer blanks than any shingle.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS n FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, n, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= n - 5 UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * both_.n >= 75 * (x.n + y.n - both_.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, coalesce(min(reach.b), w.doc_id) AS component_id FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

#: All pairs of an anchor and a row; components are whole, so their products and sums are exact as doubles.
OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW o AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER o <= 10
"""

QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS row FROM documents),
t AS (SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
w AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM t),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM w, range(3) AS o(k) WHERE w.n >= 2 GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.row = d.row)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""

SHARDING_LAWS_SQL = """
SELECT count(*) AS documents, CAST(sum(octet_length(encode(coalesce(text, ''))) + 16) AS BIGINT) AS total_size, CAST(0 AS BIGINT) AS split_groups, CAST(0 AS BIGINT) AS gaps, true AS in_range FROM documents
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_html": op4_html,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
    "quality_base": quality_base,
    "sharding_laws": sharding_laws,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op3_ngram_join": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op12_hard_negatives": OP12_SQL, "quality_base": QUALITY_BASE_SQL, "sharding_laws": SHARDING_LAWS_SQL}

"""The pipeline's stages against what they promise, on the smallest tables."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(P.written(stage(spark, tables[-1], SF), "stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    raw, good, single, apart, mixed, coded = ([tuple(r) for r in t.select("doc_id", "text").collect()] if t.columns == docs.columns else t.collect() for t in tables)
    # quality: what stays has the words, what goes failed a rule
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert set(good) <= set(raw) and all(len(words(t)) >= 50 for _, t in good)
    # exact: the largest id of equal texts
    last = collections.defaultdict(int)
    for i, t in good:
        k = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        last[k] = max(last[k], i)
    assert sorted(i for i, _ in single) == sorted(last.values())
    # near: the least id of each component
    assert sorted(i for i, _ in apart) == sorted({c for _, c in brute(dict(single)).values()})
    # mixing: whole copies of what was there, up to two
    copies = collections.Counter(mixed)
    assert set(copies) <= set(apart) and max(copies.values()) <= 2
    total = sum(len(words(t)) for _, t in apart)
    assert 0.5 * total < sum(len(words(t)) for _, t in mixed) <= 2 * total
    # tokens
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(apart)
    assert collections.Counter(r["doc_id"] for r in coded) == collections.Counter(i for i, _ in mixed)
    # run() is these stages, one after the other
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in P.run(spark, SF).collect()) == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in coded)
    for r in coded[:40]:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_empty_tables_and_clashing_columns(spark):
    """Columns named as the stages name their own stay as they are; empty tables stay empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("copies", "row", "of", "kept", "size", "taken", "component_id", "__row", "__of", "__times", "__copy", "__path", "digest", "_metadata")
    odd = P.written(docs.select("*", *(F.col("doc_id").cast("string").alias(c) for c in names)), "odd")
    for table in (odd, odd.where("false")):
        for _, stage in P.STAGES[:-1]:
            table = P.written(stage(spark, table, SF), "stage")
            assert table.columns == odd.columns
            assert table.where(" or ".join(f"`{c}` <> cast(doc_id as string)" for c in names)).count() == 0
        assert P.bpe_stage(spark, table, SF).count() == table.count()
    assert table.count() == 0


def test_stages_decide_by_row(spark):
    """Exact copies with equal ids, several texts of one id, and a null id of many rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("text is not null").orderBy("doc_id").first().asDict()
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(5, words(0))] * 4 + [(5, words(1)), (5, "short")] + [(None, words(2))] * 3 + [(None, words(3)), (None, words(3) + " end"), (7, words(3) + " last")] + [(None, words(k)) for k in range(10, 40)]
    table = spark.createDataFrame([tuple((first | {"doc_id": i, "text": t}).values()) for i, t in texts], docs.schema).repartition(5)
    got = lambda df: collections.Counter(tuple(r) for r in df.select("doc_id", "text").collect())
    good = P.quality_stage(spark, table, SF)
    assert got(good) == collections.Counter(x for x in texts if x[1] != "short")
    single = P.written(P.exact_stage(spark, good, SF), "stage")
    assert got(single) == collections.Counter(set(got(good)))
    apart = P.written(P.ngram_stage(spark, single, SF), "stage")
    assert got(apart) == collections.Counter(x for x in got(single) if x not in [(None, words(3)), (None, words(3) + " end")])
    mixed = got(P.mixing_stage(spark, apart, SF))
    total = sum(len(t.split()) for _, t in got(apart))
    assert set(mixed) <= set(got(apart)) and max(mixed.values()) <= 2
    assert total < sum(n * len(t.split()) for (_, t), n in mixed.items()) <= 2 * total


def test_key_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, docs.union(docs).repartition(3), P.written(docs.repartition(4), "stage"), docs.where("false")):
        rows, row = P.with_key(table)
        first = {r[row]: r["doc_id"] for r in rows.select("doc_id", row).collect()}
        assert len(first) == table.count() and first == {r[row]: r["doc_id"] for r in rows.repartition(5).collect()}


def test_key_of_rows_of_many_files(spark, monkeypatch):
    """Beyond the files that are numbered, rows are written with a key."""
    monkeypatch.setattr(P, "MOST_FILES", 2)
    docs = P.written(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), "stage")
    rows, row = P.with_key(docs)
    first = {r[row]: r["doc_id"] for r in rows.select("doc_id", row).collect()}
    assert len(first) == docs.count() and first == {r[row]: r["doc_id"] for r in rows.repartition(3).collect()}

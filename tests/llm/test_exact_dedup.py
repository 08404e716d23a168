import hashlib
import random
import re

import pytest

from glucolake.llm.exact_dedup import exact_groups, keep_rows


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 13])
def test_equals_brute_force(spark, keep, parts):
    rng = random.Random(parts)
    texts = ["Same", "same", "SAME É", "same é", "same É", "", None, *(f"t{k}" for k in range(40))]
    rows = [(i, rng.choice(texts), "z") for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(parts)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    pick = max if keep == "largest" else min
    want = {(i, pick(groups[lower(t)]), len(groups[lower(t)]), i == pick(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows}
    assert {tuple(r) for r in exact_groups(df, keep=keep).collect()} == want


def test_one_hot_text_fan_in_two(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text").repartition(9)
    got = exact_groups(df, fan_in=2).where("group_size > 1").collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got} == {2997} and sum(r["kept"] for r in got) == 1


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (5, "A"), (None, "b"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, False), (None, None, 1, True), (None, None, 1, True)], key=str)
    assert exact_groups(df.where("false")).count() == 0


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        exact_groups(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_keep_rows(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, "A", 8), (None, "c", 9)], "doc_id long, text string, kept int")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in keep_rows(df, exact_groups(df)).collect()) == [(0, 9), (2, 8)]


def test_more_slices_than_partitions(spark, monkeypatch):
    """Slices follow the number of texts, not a setting of the session."""
    monkeypatch.setattr("glucolake.llm.exact_dedup.SLICE_TEXTS", 20)
    df = spark.range(1500).selectExpr("id as doc_id", "concat('t', id % 700) as text").repartition(3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(df).collect()}
    assert got == {i: (i % 700 + 1400 if i % 700 < 100 else i % 700 + 700, 3 if i % 700 < 100 else 2) for i in range(1500)}


def test_very_long_texts(spark):
    """Whole texts count: two that differ in their last letter after two million are not equal, a copy in other case is."""
    long_ = "ab " * 700_000
    rows = spark.createDataFrame([(1, long_ + "x"), (2, long_ + "y"), (3, long_.upper() + "X"), (4, "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(rows).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}

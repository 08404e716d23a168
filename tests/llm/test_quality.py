import math
import random
import re

import pytest

from glucolake.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a", "x|y <b> #1 ** é ü k", "l\nl\n\nl \nl\n", "a b c d " * 5000]
    texts += [" ".join(rng.choice("ab c\n d# e é".split(" ")) for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.measures(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_certified_is_the_exact_binomial_bound():
    for n, k, limit, level in [(600, 0, 0.0125, 0.0025), (400, 0, 0.0125, 0.0025), (5000, 30, 0.0125, 0.0025), (5000, 45, 0.0125, 0.0025), (50, 5, 0.2, 0.05)]:
        p = sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1))
        assert Q.certified(k, n, limit, level) == (p <= level)
    assert not Q.certified(0, 0, 0.1, 0.1)


def corpus(spark, n=3000):
    """Good texts, and bad ones full of symbols; one stratum has too few labels to certify anything."""
    def text(i):
        words = [f"w{i}x{k}" for k in range(60)]
        return " ".join(w + "###" * (i % 5 == 0) for w in words)

    rows = [(i, text(i), "rare" if i % 100 == 1 else "en" if i % 2 else None) for i in range(n)]
    labels = [(i, 0 if i % 5 == 0 else 1) for i in range(n)] + [(None, 1), (3, None), (10**6, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_reject_bad_and_keep_good(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in Q.quality_rules(docs, labels).collect()}
    assert all(r["kept"] for i, r in got.items() if i % 5)
    assert not any(r["kept"] for i, r in got.items() if i % 5 == 0 and i % 100 != 1)


def test_cutoffs_equal_brute_force_and_hold_the_risk(spark):
    docs, labels = corpus(spark)
    table = Q.measures(docs, also=("lang",)).cache()
    cuts = Q.cutoffs(table, labels)
    good = [r for r in table.collect() if r["doc_id"] % 5]
    strata = {s: [r for r in good if r["lang"] == s] for s in {r["lang"] for r in good}}
    pooled = {}
    for s, rows in strata.items():
        pooled.setdefault(s if len(rows) >= Q.MIN_STRATUM else "", []).extend(rows)
    level = Q.DELTA / (len({*pooled, ""}) * len(Q.RULES))
    for s, rows in pooled.items():
        for rule in Q.RULES:
            want = None
            for cut in Q.GRID:
                if not Q.certified(sum(r[rule] > cut for r in rows), len(rows), Q.ALPHA / len(Q.RULES), level):
                    break
                want = cut
            assert cuts[s].get(rule) == want
    lost = sum(any(r[rule] > cuts[r["lang"] if r["lang"] in cuts else ""].get(rule, 1.0) for rule in Q.RULES) for r in good)
    assert lost <= Q.ALPHA * len(good)


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark, 50)
    assert all(r["kept"] for r in Q.quality_rules(docs, labels.where("false")).collect())
    assert Q.quality_rules(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("words,want", [(49, True), (50, False)])
def test_base_limits(spark, words, want):
    df = spark.createDataFrame([(1, " ".join(f"u{k}" for k in range(words)))], "doc_id long, text string")
    assert Q.measures(df).first()["base_failed"] is want


def test_small_and_unlabelled_strata_lose_nothing(spark):
    """Strata without a guarantee of their own aren't judged by the cutoffs of others."""
    text = lambda i, up: " ".join((f"W{i}X{k}" if up else f"w{i}x{k}") for k in range(60))
    size = {"big": 900, "none": 40, "capitals": 60, **{f"small{k}": 90 for k in range(6)}}
    rows = [(s, f"{s}{i}") for s, n in size.items() for i in range(n)]
    docs = spark.createDataFrame([(k, text(i, s in ("none", "capitals")), s) for k, (s, i) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k, (s, _) in enumerate(rows) if s != "none"], "doc_id long, quality int")
    cuts = Q.cutoffs(Q.measures(docs, also=("lang",)), labels)
    assert {s for s, by in cuts.items() if by} == {"big"} and cuts["big"]["shout_ratio"] == min(Q.GRID)
    assert Q.quality_rules(docs, labels).where("not kept").count() == 0


def test_least_stratum_is_the_least():
    for strata in (1, 2, 7, 100):
        n = Q.least_stratum(strata)
        assert Q.certified(0, n, Q.ALPHA / len(Q.RULES), Q.DELTA / (strata * len(Q.RULES))) and not Q.certified(0, n - 1, Q.ALPHA / len(Q.RULES), Q.DELTA / (strata * len(Q.RULES)))

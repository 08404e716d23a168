"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glucolake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, near string, node long"


def words_of(rows):
    """The contract, word by word."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(vocabulary):
    forms, rows = {}, {}
    for w, n in vocabulary.items():
        others = [x for x in vocabulary if near(w, x)]
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        forms[w] = best if best and vocabulary[best] >= 5 * n else None
        rows[w] = (n, len(others))
    out = set()
    for w, (n, n_near) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, n_near, vocabulary.get(forms[w])))
    return out


def got(docs):
    rows = spelling.variant_groups(spelling.vocabulary(docs, change=spelling.garbled)).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "x", 2) for i, t in rows], SCHEMA)


def random_texts(seed, documents=60):
    """Words over a small alphabet, so that many are near each other, with frequencies far apart, and chains of forms."""
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcé"), rng.integers(6, 9))) for _ in range(12)]
    pool = []
    for s in stems:
        for _ in range(6):
            w = list(s)
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(len(w))
                w[i : i + 1] = [[], [w[i], "b"], ["c"], ["É"]][rng.integers(4)]
            pool.append("".join(w))
    weight = 1.0 / np.arange(1, len(pool) + 1) ** 2
    return [(i, " ".join(rng.choice(pool, 150, p=weight / weight.sum())) + " Straße; ABCABCA, straße-ÉTUDES") for i in range(documents)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = random_texts(seed)
        want = expected(words_of(rows))
        assert got(frame(spark, rows).repartition(4)) == want
        assert any(r[1] for r in want) and any(r[4] > 2 for r in want)


def test_chains_of_forms(spark):
    """Each form five times as frequent as the last: the root is the end of the chain."""
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r.word: (r.form, r.root) for r in spelling.variant_groups(vocabulary).collect()}
    assert rows["aaaaaa"] == ("aaaaab", "aabbbb") and rows["aaabbb"] == ("aabbbb", "aabbbb") and rows["aabbbb"] == (None, "aabbbb")


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, "aaaaab " * 25 + "aaaaac " * 25 + "aaaaaa " * 5), (2, None), (None, "qwertz qwertz qwertz"), (None, "qwertz qwertz qwertz"), (3, ""), (4, "one two 3")]
    assert got(frame(spark, rows)) == expected(words_of(rows))
    assert got(frame(spark, [])) == set() and got(frame(spark, [(1, "short")])) == set()


def test_very_long_text(spark):
    rows = [(5, "".join(w for _, w in random_texts(4, 20)) * 60)]
    assert len(rows[0][1]) > 1_000_000
    assert got(frame(spark, rows)) == expected(words_of(rows))


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """Where the filter is far too small for the vocabulary, all pairs are found all the same."""
    monkeypatch.setattr(spelling, "FILTER_BITS", 64)
    monkeypatch.setattr(spelling, "PIECE_BITS", 64)
    rows = random_texts(7, 30)
    assert got(frame(spark, rows)) == expected(words_of(rows))


def test_hashes_of_neighbours_are_those_of_their_texts():
    words, alphabet = ["abcdef", "aaaaaa", "zzyzzx"], np.array([ord(c) for c in "abzÿ"], np.uint32)
    value = lambda w: int(spelling.hashes(spelling._codes([w]))[0])
    for kind, h in spelling.neighbours(spelling._codes(words), alphabet):
        for row, w in zip(h, words, strict=True):
            for i, cell in enumerate(row):
                if kind == "delete":
                    assert int(cell) == value(w[:i] + w[i + 1 :])
                else:
                    assert [int(x) for x in cell] == [value(w[:i] + chr(c) + w[i + (kind == "replace") :]) for c in alphabet]


def test_extra_columns(spark):
    docs = spark.createDataFrame([(i, "abcdef abcdeg") for i in range(6)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("form", "root", "end", "__word", "__near")})
    assert {r[0] for r in got(docs)} == {"abcdef", "abcdeg"}

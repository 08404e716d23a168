import hashlib
import math

import pytest

from glucolake.llm import mixing as M


def rows_of(n=900, sources=5):
    return [(i, " ".join(["w"] * (i * 37 % 211)), None if i % sources == 4 else f"s{i % sources}") for i in range(n)]


def targets(sizes):
    """Shares by weight, capped at twice the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("bins", [1, 4096])
def test_targets_and_sample_equal_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(M, "BINS", bins)
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, source string, size int, copies int").repartition(7)
    got = {r["doc_id"]: r for r in M.mix(df).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = targets(total)
    u = {i: (int(hashlib.md5(f"{i}:{M.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in size}
    for s in total:
        e = expected({i: size[i] for i in size if source[i] == s}, want[s])
        rest, run = want[s] - sum(math.floor(e[i]) * size[i] for i in e), 0
        odds = {i: e[i] - math.floor(e[i]) for i in e}
        rank = {i: u[i] / (1 - u[i]) / (odds[i] / (1 - odds[i])) for i in e if odds[i] > 0}
        for i in sorted(rank, key=lambda i: rank[i]):
            more = run + size[i] / 2 <= rest and rest > 0
            run += size[i]
            if size[i]:
                assert got[i]["copies"] == math.floor(e[i]) + more, (s, i)
        for i in e:
            assert got[i]["taken"] == size[i] * got[i]["copies"] <= 2 * size[i]
            assert got[i]["target"] == pytest.approx(want[s]) and got[i]["source_size"] == total[s]
            assert i in rank or not size[i] or got[i]["copies"] == math.floor(e[i])
        assert abs(sum(got[i]["taken"] for i in e) - want[s]) <= max(size.values()) / 2 + 1


def expected(size: dict[int, int], target: float) -> dict[int, float]:
    """Copies in proportion to the binary digits of the size, at most 2, whose words are the target."""
    capped = set()
    while True:
        left = target - 2 * sum(size[i] for i in capped)
        scale = left / max(1, sum(size[i] * size[i].bit_length() for i in size if i not in capped))
        over = {i for i in size if i not in capped and scale * max(1, size[i].bit_length()) > 2}
        if not over:
            return {i: 2.0 if i in capped else min(2.0, scale * max(1, size[i].bit_length())) for i in size}
        most = max(size[i].bit_length() for i in over)
        capped |= {i for i in over if size[i].bit_length() == most}


def test_mean_copies_over_seeds_are_the_expected_ones(spark):
    """Documents of different size are drawn with different probabilities, each its own."""
    rows = [(i, " ".join(["w"] * (3, 20, 150)[i % 3]), "s0" if i < 900 else "s1") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    size = {i: len(t.split()) for i, t, _ in rows}
    own = {i for i, _, s in rows if s == "s1"}
    seeds = 12
    times = dict.fromkeys(size, 0)
    for k in range(seeds):
        for r in M.mix(df, weights=(3.0, 0.6), share=0.75, seed=f"try-{k}").collect():
            times[r["doc_id"]] += r["copies"]
    want = expected({i: size[i] for i in own}, 0.75 * sum(size.values()) * 0.6 / 3.6)
    for n in (3, 20, 150):
        ids = [i for i in own if size[i] == n]
        mean, p = sum(times[i] for i in ids) / len(ids) / seeds, want[ids[0]]
        assert 0 < p < 1 and abs(mean - p) < 4 * math.sqrt(p * (1 - p) / len(ids) / seeds) + 0.01, (n, mean, p)
    assert want[[i for i in own if size[i] == 150][0]] > 1.5 * want[[i for i in own if size[i] == 3][0]]


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(rows_of(300), "doc_id long, text string, source string")
    a, b = ({tuple(r) for r in M.mix(df.repartition(n)).collect()} for n in (1, 11))
    assert a == b


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, None), (1, "a b", "s"), (1, "a b", "s"), (2, "", "z")], "doc_id long, text string, source string")
    got = M.mix(df).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert M.mix(df.where("false")).count() == 0


def test_a_source_without_words_is_taken_once(spark):
    rows = [(1, "a b c", "s"), (2, "d e", "t"), (3, "", "empty"), (4, None, "empty"), (5, " \n", "empty"), (6, None, None)]
    got = {r["doc_id"]: r["copies"] for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i] for i in (3, 4, 5, 6)] == [1, 1, 1, 1]


def test_very_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 1_000_000, "s", 7), (2, "a b", "s", 7), (3, "c", "t", 7)], "doc_id long, text string, source string, size int")
    got = {r["doc_id"]: r["size"] for r in M.mix(df.withColumnRenamed("size", "copies")).collect()}
    assert got == {1: 1_000_000, 2: 2, 3: 1}

"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from glucolake.llm import ngram_join as N


def brute(texts: dict[int, str | None], words: int = 5, threshold: int = 75) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near(rng: random.Random, words: list[str], changes: int) -> list[str]:
    words = list(words)
    for _ in range(changes):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(k, f"n{rng.random()}"), lambda: words.insert(k, "extra"), lambda: len(words) > 1 and words.pop(k)])()
    return words


def corpus(seed: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n ", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e f g", "x " * 400]
    shared = [f"s{i}" for i in range(60)]
    for n in (3, 5, 6, 7, 8, 9, 12, 20, 33, 63, 64, 70, 130, 300, 600, 1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(6):
            out.append(" ".join(near(rng, base, rng.randrange(0, 1 + max(1, n // 25)))))
        out.append(" ".join(base + shared))
        out.append(" ".join(base).upper())
    rng.shuffle(out)
    return {7 * i + 1: t for i, t in enumerate(out)}


def got(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "doc_id long, text string, doc string, a string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    assert got(spark, texts) == brute(texts)


def test_driver_documents_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert got(spark, texts) == brute(texts)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, N.jaccard_components(df).collect()), key=str) == [(1, 2, 1), (None, None, None)]
    assert N.jaccard_components(df.where("false")).count() == 0


@pytest.mark.parametrize("hub", [0, 5000])
def test_components_with_a_hub(spark, monkeypatch, hub):
    """A node of many links, be its id the least or the largest, never has more rows than there are tasks; chains and several targets come to the least id."""
    import glucolake.llm.components as K

    rng = random.Random(hub)
    links = [(hub, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(6000, 6060)] + [(6010, 20), (7000, 7001), (7001, 7000), (8, 8)]
    links += [(rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(300)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    most = []
    real = K.written

    def watched(df, name):
        out = real(df, name)
        most.append(out.groupBy("node").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(K, "written", watched)
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: find(x) for x in {n for p in links for n in p} if find(x) != x}
    assert max(most) <= 8
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_forest_hands_on_what_it_has(spark, monkeypatch):
    """With a small bound on a task's nodes the forests come in parts and later steps have more partitions."""
    import glucolake.llm.components as K

    monkeypatch.setattr(K, "NODES", 50)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300) if i % 7] + [(0, 7 * i) for i in range(1, 40)] + [(rng.randrange(500, 2000), rng.randrange(500, 2000)) for _ in range(900)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {x: find(x) for x in {n for p in links for n in p} if find(x) != x}


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        N.jaccard_components(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_repeated_rows(spark):
    """Rows of one id are one document with all their shingles."""
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(8))
    rows = [(3, x), (7, x), (7, y), (9, y), (9, y), (11, x), (12, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.jaccard_components(df).collect())) == [(3, 26, 3), (7, 30, 3), (7, 30, 3), (9, 4, 9), (9, 4, 9), (11, 26, 3), (12, 4, 9)]


def templated(n: int, own: int = 2) -> dict[int, str]:
    """Texts of one template of 40 words with own words in the middle: no two link, all share most of their shingles."""
    return {i: " ".join([*(f"t{k}" for k in range(20 - own)), *(f"own{k}x{i}" for k in range(own)), *(f"t{k}" for k in range(20, 40))]) for i in range(n)}


def test_templates_cost_in_proportion(spark, monkeypatch):
    """Sets that a template makes meet in long lists are left out by their sizes, not tested with each other."""
    assert got(spark, templated(200)) == brute(templated(200))
    tested = []
    real = N.rest_links

    def counted(lists, *rest):
        tested.append(lists.count())
        return real(lists, *rest)

    monkeypatch.setattr(N, "rest_links", counted)
    for n in (1000, 8000):
        texts = templated(n) | {n + i: t for i, t in enumerate(templated(40, 1).values())}
        assert {c for i, (_, c) in got(spark, texts).items() if i < n} == set(range(n))
    assert tested[1] <= 8 * max(tested[0], 100)


def slotted(n: int, words: int) -> dict[int, str]:
    """Texts of 34 words with two slots, each filled from a vocabulary of its own: those that have one slot alike are just too far apart to link."""
    fill = [(a, b) for a in range(words) for b in range(words)]
    random.Random(n).shuffle(fill)
    return {i: " ".join([*(f"t{k}" for k in range(11)), f"a{a}", *(f"t{k}" for k in range(11, 22)), f"b{b}", *(f"t{k}" for k in range(22, 32))]) for i, (a, b) in enumerate(fill[:n])}


def test_slots_are_not_tested_all_with_all(spark, monkeypatch):
    """Texts filled from a small vocabulary meet at their slots' words, not at the template's."""
    assert got(spark, slotted(150, 20)) == brute(slotted(150, 20))
    tested = []
    real = N.test_blocks

    def counted(table, threshold):
        side = table.column("side").to_numpy()
        left, right = int((side == 0).sum()), int((side == 1).sum())
        seen.add(left * (right or left))
        return real(table, threshold)

    monkeypatch.setattr(N, "test_blocks", counted)
    for n in (1000, 2000):
        seen = spark.sparkContext.accumulator(0)
        assert {c for _, c in got(spark, slotted(n, 60)).values()} == set(range(n))
        tested.append(seen.value)
    assert tested[0] <= 1000**2 // 10 and tested[1] <= 2000**2 // 10


@pytest.mark.parametrize(("flush", "hot"), [(300, 32), (300, 3), (10**6, 32)])
def test_hot_tokens_and_small_flushes(spark, monkeypatch, flush, hot):
    """Tokens that many sets of a flush have, in one flush or several."""
    monkeypatch.setattr(N, "FLUSH", flush)
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "MOST_FLUSH", flush)
    rng = random.Random(9)
    line = [f"c{i}" for i in range(25)]
    texts = {i: " ".join(near(rng, line, rng.randrange(3)) + [f"z{rng.randrange(40)}" for _ in range(rng.randrange(12))]) for i in range(150)}
    assert got(spark, texts) == brute(texts)


def test_pairs_that_link_share_a_key():
    """Also where most segments of a set are empty: the pigeonhole holds with neighbourhoods, and what falls short is told."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 80), 150, 500, 1000, 3000]:
        for _ in range(20 if n < 100 else 4):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            most = int(N.most_apart(np.array([n]), np.array([100 * n // 75]), 75)[0])
            more = int(rng.integers(0, most + 1))
            less = int(rng.integers(0, most - more + 1))
            a = np.unique(base)
            b = np.unique(np.r_[base[less:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            keys, owner, low, _, short = N.keys_of(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            for_other = low <= np.array([len(b), len(a)])[owner]
            assert len(short) or set(keys[(owner == 0) & for_other]) & set(keys[(owner == 1) & for_other]), (n, more, less)


def test_contained_pairs_equal_brute_force(spark):
    """A set and the first tokens of it, in the band below: the pair differs in as many tokens as its sizes allow."""
    rng = random.Random(5)
    texts = {}
    for whole, part in [(18, 14), (20, 15), (17, 13), (16, 12), (19, 15), (36, 27), (37, 28), (34, 30), (70, 53), (81, 61), (134, 101)]:
        for _ in range(12):
            words = [f"w{rng.randrange(10**9)}" for _ in range(whole + 4)]
            for n in (whole, part):
                texts[len(texts)] = " ".join(words[: n + 4])
    assert got(spark, texts) == brute(texts)


@pytest.mark.parametrize("threshold", [50, 60, 75, 80, 90])
def test_bound_holds_for_all_partner_sizes(threshold):
    for size in range(1, 300):
        for largest in range(size * threshold // 100 + 1, 100 * size // threshold + 1):
            sizes = np.arange(-(-threshold * size // 100), largest + 1)
            if len(sizes):
                assert N.furthest(np.array([size]), np.array([largest]), threshold)[0] >= N.most_apart(np.full(len(sizes), size), sizes, threshold).max()


def test_words_of_long_buffers(monkeypatch):
    """Cut between words, also where a word is longer than a cut, hashes and starts are the same."""
    rng = random.Random(2)
    text = b"".join(rng.choice([b" ", b"\n\t", b"  "]) + bytes(rng.choices(b"abcXYZ\xc3\xa9", k=rng.choice([1, 3, 8, 120]))) for _ in range(900)) + rng.choice([b"", b" "])
    want = N.word_hashes(text)
    assert want[0].tolist() == [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    for size in (1, 7, 50, 1000, len(text), len(text) + 1):
        monkeypatch.setattr(N, "HASHED", size)
        for a, b in zip(N.word_hashes(text), want, strict=True):
            assert (a == b).all()
    assert len(N.word_hashes(b"")[0]) == 0


def test_short_texts_alone(spark):
    """A slice of few words in all, in numpy and as partitions of one row."""
    texts = {n: " ".join("abcdef"[:n]) for n in range(1, 7)}
    for n, text in texts.items():
        assert N.shingle_sets([text.encode()])[1].tolist() == [0, max(1, n - 4)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), len(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_components(df).collect()} == brute(texts)

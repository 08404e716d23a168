"""Packing: the contract's columns against the tokenizers library, plans against brute force."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glucolake.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, length int, bin string, sequence_id string, offset int, __part int"


def check(rows, texts, limit):
    """Every whole text's ids and the end id are in the pieces, and the pieces fill sequences without gaps."""
    library = Tokenizer.from_file(FILE)
    library.no_truncation()
    library.no_padding()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, held = defaultdict(dict), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert pieces[r.doc_id].setdefault(r.piece, (r.start, r.length)) == (r.start, r.length)
        held[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        lengths = [n for _, (_, n) in sorted(found.items())]
        assert sorted(found) == list(range(len(found))) and sum(lengths) == len(ids[i]) and set(lengths[1:]) <= {limit}
        assert [s for _, (s, _) in sorted(found.items())] == [0, *itertools.accumulate(lengths[:-1])]
    for stretches in held.values():
        stretches.sort()
        assert [a for a, _ in stretches] == [0, *itertools.accumulate(n for _, n in stretches[:-1])] and sum(n for _, n in stretches) <= limit
    return len(held)


def test_whole_texts_are_packed(spark):
    rng = np.random.default_rng(3)
    words = "the of and to in is that for was with as his on be at by had not are but from or have an they which one you were her all she there would their".split()
    texts = {i: " ".join(rng.choice(words, n)) for i, n in enumerate(rng.integers(0, 150, 300).tolist())}
    texts |= {300: None, 301: "", 302: "x " * 40_000, 303: "é" * 5, 304: " ".join(words * 2)[:127], 305: texts[7], 306: texts[7]}
    docs = spark.createDataFrame([(i, t, "p", 1, "b", "s", 2, 3) for i, t in texts.items()], SCHEMA).repartition(5)
    got = packing.pack_documents(docs, FILE, limit=128, keep_ids=True)
    rows = got.collect()
    total = sum(r.length for r in rows)
    assert check(rows, texts, 128) <= 1.02 * -(-total // 128)
    whole = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in whole) == total and all(len(r.ids) <= 128 for r in whole)
    assert dict(got.dtypes)["doc_id"] == "bigint" and set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"}


def test_empty_null_ids_and_repeats(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, None), (1, "c"), (1, "c")], "doc_id long, text string"), FILE).collect()
    assert len(rows) == 4 and {r.sequence_id for r in rows} == {rows[0].sequence_id} and sorted(r.offset for r in rows)[0] == 0


@pytest.mark.parametrize("sizes, demand, best", [([6, 4, 3], [4, 4, 6], 6), ([7, 5, 3], [3, 6, 3], 6), ([10], [5], 5), ([6], [4], 4)])
def test_configurations_meet_demand_with_fewest(sizes, demand, best):
    found = packing.configurations(sizes, demand, 10)
    assert all(c @ np.array(sizes) <= 10 for c, _ in found)
    assert (sum(u * c for c, u in found) >= np.array(demand) - 1e-6).all() and sum(u for _, u in found) <= best + 1e-3


def place(lengths, limit):
    lengths = np.array(lengths, np.int64)
    values, n = np.unique(lengths, return_counts=True)
    groups = packing.Groups(dict(zip(values.tolist(), n.tolist(), strict=True)), limit)
    small = lengths[lengths < limit]
    bins, rest = groups.place(small, packing._nth(small, np.zeros(limit + 1, np.int64)))
    fill = np.bincount(bins[bins >= 0], weights=small[bins >= 0], minlength=groups.bins).astype(int)
    for length in set(small.tolist()):
        went_on = sorted(rest[(small == length) & (bins < 0)].tolist())
        assert went_on == list(range(groups.left.get(length, 0)))
    return groups, fill


@pytest.mark.parametrize("lengths", [np.random.default_rng(1).integers(1, 2049, 3000), np.random.default_rng(2).integers(600, 1000, 3000), np.full(1000, 700), np.r_[np.full(500, 683), np.arange(1, 300)], [5] * 9, [2048] * 3])
def test_slots_hold_what_is_put_there(lengths):
    groups, fill = place(lengths, 2048)
    assert (fill <= 2048).all() and groups.full == sum(x == 2048 for x in lengths)
    rooms = {int(r): int((2048 - fill == r).sum()) for r in set((2048 - fill).tolist())}
    _, new = packing.best_fit(groups.left, rooms)
    plain = packing.best_fit({int(x): int((np.array(lengths) == x).sum()) for x in set(np.array(lengths).tolist())}, {})[1]
    assert groups.full + groups.bins + new <= 1.01 * plain + 2


def test_best_fit_equals_one_by_one():
    """Stretches of like sequences give the same rooms as putting each piece into the fullest sequence that has room."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        rooms = rng.integers(1, 40, 12).tolist()
        pieces = sorted(rng.integers(1, 30, 40).tolist(), reverse=True)
        left = list(rooms)
        new = 0
        for p in pieces:
            fits = [i for i, r in enumerate(left) if r >= p]
            if not fits:
                left.append(40)
                new += 1
                fits = [len(left) - 1]
            at = min(fits, key=lambda i: left[i])
            left[at] -= p
        plan, made = packing.best_fit({p: pieces.count(p) for p in set(pieces)}, {r: rooms.count(r) for r in set(rooms)}, 40)
        used, done = defaultdict(int), defaultdict(int)
        for (length, first, each, room, at), after in zip(plan.tolist(), [*plan.tolist()[1:], None], strict=True):
            n = (after[1] if after and after[0] == length else pieces.count(length)) - first
            done[length] += n
            for k in range(n):
                used[room, at + k // each] += length
        assert made == new and all(used[r] <= r[0] for r in used) and sum(done.values()) == 40
        ended = sorted([r - used.get((r, rooms[:i].count(r)), 0) for i, r in enumerate(rooms)] + [40 - used[40, i] for i in range(made)])
        assert ended == sorted(left)


def test_columns_of_the_rows_stay_out_of_the_way(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("start", "ids_crc32", "__nth", "__rank", "room", "ids")})
    assert packing.pack_documents(docs, FILE).count() == 1

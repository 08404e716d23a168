"""Hard negatives against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glucolake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key long, vec string, windows string, `group` int, block int, id int"


def brute_force(rows):
    """The contract, pair by pair; rows in the order of the table."""
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64), label))
    width = max((len(v) for _, v, _ in good), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v, _ in good]).reshape(len(good), width)
    out = []
    for a, (i, _, label) in enumerate(good):
        if i % 100:
            continue
        scores = (m @ m[a]).tolist()
        order = sorted((b for b in range(len(good)) if b != a), key=lambda b: (-scores[b], good[b][0]))
        for p in [b for b in order if good[b][2] == label][:5]:
            fits = [b for b in order if good[b][2] != label and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out += [(i, good[p][0], n + 1, good[b][0], scores[p], scores[b]) for n, b in enumerate(fits[:10])]
    return sorted(out)


def got(spark, rows, parts=4):
    df = spark.createDataFrame([(i, v, label, 1, "v", "w", 2, 3, 4) for i, v, label in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.mine(df, F.col("id") % 100 == 0).collect())


def cluster(seed, n=900, width=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, width))
    return [(i, (centres[rng.integers(6)] + rng.normal(0, 0.15, width)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_equals_brute_force(spark):
    rows = cluster(1)
    want = brute_force(rows)
    assert len(want) > 200 and got(spark, rows) == want


def test_several_blocks_of_anchors_and_vectors(spark, monkeypatch):
    for name, value in (("ANCHORS", 3), ("VECTORS", 200), ("LEAST_VECTORS", 50), ("STEP", 2), ("ROW", 37), ("HELD", 50)):
        monkeypatch.setattr(hn, name, value)
    rows = cluster(2)
    assert got(spark, rows) == brute_force(rows)


def test_copies_of_one_vector_under_many_labels(spark):
    """A third of the rows are one vector, anchors among them; ties go by id."""
    rows = cluster(3, 600)
    rows += [(600 + i, [0.4] * 12, i % 3) for i in range(300)]
    assert got(spark, rows) == brute_force(rows)


def test_rows_that_take_no_part(spark):
    rows = cluster(4, 300)
    rows += [(1000, None, 1), (1100, [0.5] * 12, None), (None, [0.5] * 12, 1), (1200, [0.5] * 11 + [None], 1), (1300, [0.5] * 11 + [float("nan")], 1), (1301, [float("inf")] * 12, 2), (1400, [], 1), (1500, [0.9] * 3, 2)]
    want = brute_force(rows)
    assert got(spark, rows) == want and {0, 100, 200} <= {r[0] for r in want}


def test_few_rows_empty_tables_and_no_anchor(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == [] and got(spark, [(100, [1.0], 1)]) == []
    rows = [(100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.3], 2), (3, [-1.0, 0.0], 2), (4, [0.0, 0.0], 1)]
    assert got(spark, rows) == brute_force(rows) == [(100, 1, 1, 2, 256 * 230, 256 * 179)]


def test_repeated_ids(spark):
    rows = [(i % 150, v, label) for i, v, label in cluster(5, 450)]
    numbers = lambda found: sorted((a, n, p, q) for a, _, n, _, p, q in found)
    assert numbers(got(spark, rows, 1)) == numbers(brute_force(rows))


def test_components_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="is beyond"):
        got(spark, [(100, [1e9], 1), (1, [1.0], 2)])


def test_bounds_hold_scores():
    """Every score lies within its bounds, also for anchors and vectors outside the sample."""
    rng = np.random.default_rng(6)
    cells = object.__new__(hn.Cells)
    sample = np.sort(rng.integers(-40, 40, (100, 8)), axis=0)
    cells.low = np.maximum.accumulate(np.vstack([[-200] * 8, sample[(np.arange(1, hn.CELLS) * 100) // hn.CELLS]]), axis=0).T.copy()
    cells.high = np.maximum(np.c_[cells.low[:, 1:] - 1, np.full(8, 200)], cells.low)
    vectors, anchors = rng.integers(-200, 201, (300, 8)), rng.integers(-200, 201, (20, 8)).astype(np.int32)
    best = hn.Best(np.arange(20), np.zeros(20, np.int64), anchors, np.tile(np.array([[-1 << 40, 1 << 40]]), (20, 1, 1)), 5, True, np.float64)
    edges = cells.edges(cells.codes(vectors)).astype(float)
    scores = anchors.astype(np.int64) @ vectors.T
    assert (best.under @ edges.T <= scores).all() and (scores <= best.over @ edges.T).all()
    best.add(np.arange(300), np.zeros(300, np.int64), edges)
    kept = best.rows().to_pandas()
    for a in range(20):
        assert set(np.argsort(-scores[a], kind="stable")[:5]) <= set(kept[kept.anchor == a].key) and len(kept[kept.anchor == a]) < 300


def test_matrix_of_odd_rows():
    rows, m = hn._matrix(pa.array([[0.1, -0.1], None, [1.0], [], [None], [float("inf"), 1.0]], pa.list_(pa.float32())), 256)
    assert rows.tolist() == [0, 2, 3] and m.tolist() == [[25, -26], [256, 0], [0, 0]]

"""Forests of many subjects against trees grown one node at a time in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucolake.config import PredictiveParams
from glucolake.operators import export as E
from glucolake.operators import forest
from glucolake.operators import predictive as R

NAMES = ["a", "b", "c", "d", "e"]


def examples(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in (("A", 400), ("B", 150), ("C", 60)):
        x = rng.normal(size=(n, 5)).round(2)
        y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.4, n) > 0.6).astype(int)
        rows += [(i, len(rows) + k, int(y[k]), bool(k % 4), n, *map(float, x[k])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id string, key long, target int, train boolean, total long, a double, b double, c double, d double, e double")


def plain_forest(rows, edges, trees, depth, seed=1):
    """Scores by key and importances of one subject, node by node."""
    code = {r[1]: [sum(e < v for e in edges[j]) for j, v in enumerate(r[5:])] for r in rows}
    total, importance = {k: 0.0 for k in code}, np.zeros(len(NAMES))
    gini = lambda n, e: 2 * e * (n - e) / n if n else 0.0
    for t in range(trees):
        drawn = {r[1]: int(forest.row_weights(np.array([r[1]]), t, seed)[0]) for r in rows if r[3]}
        events = {r[1]: r[2] for r in rows}

        def leaf(node, bag, keys, level):
            n, e = sum(drawn[k] for k in bag), sum(drawn[k] * events[k] for k in bag)
            best = None
            if level < depth and n > forest.LEAST_NODE and 0 < e < n:
                for f in forest.candidates(t, np.array([node]), len(NAMES), seed)[0].tolist():
                    for b in range(forest.BINS):
                        left = [k for k in bag if code[k][f] <= b]
                        nl, el = sum(drawn[k] for k in left), sum(drawn[k] * events[k] for k in left)
                        if 0 < nl < n:
                            gain = gini(n, e) - gini(nl, el) - gini(n - nl, e - el)
                            if best is None or gain > best[0] + 1e-12:
                                best = gain, f, b
            if best is None or best[0] <= 1e-12:
                for k in keys:
                    total[k] += e / max(n, 1)
                return
            gain, f, b = best
            importance[f] += gain
            for side in (0, 1):
                goes = lambda ks: [k for k in ks if (code[k][f] > b) == side]  # noqa: B023, E731
                leaf(2 * node + side, goes(bag), goes(keys), level + 1)

        leaf(1, [k for k, w in drawn.items() if w], list(code), 0)
    return {k: v / trees for k, v in total.items()}, importance / trees


@pytest.mark.parametrize("chunk, fan_in", [(10_000, 8), (37, 2)])
def test_equals_trees_grown_node_by_node(spark, monkeypatch, chunk, fan_in):
    """Also where a subject is dealt into many chunks whose counts are added up in rounds."""
    monkeypatch.setattr(forest, "CHUNK", chunk)
    monkeypatch.setattr(forest, "FAN_IN", fan_in)
    monkeypatch.setattr(forest, "BLOCK", 2)
    rows, df = examples(spark)
    grown = forest.Forests(df.repartition(3), NAMES, trees=5, depth=4)
    edges = {r["id"]: np.array(r["edges"]).reshape(5, -1) for r in grown.subjects.collect()}
    scores = {r["key"]: r["probability"] for r in grown.scores().collect()}
    importance = {(r["id"], r["feature"]): r["importance"] for r in grown.importance().collect()}
    assert scores.keys() == {r[1] for r in rows}
    for i in "ABC":
        want, gains = plain_forest([r for r in rows if r[0] == i], edges[i], 5, 4)
        assert all(scores[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
        assert [importance[i, f] for f in NAMES] == pytest.approx(gains.tolist())


def test_draws_are_poisson_and_candidates_distinct():
    w = np.concatenate([forest.row_weights(np.arange(20_000), t, 1) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.03
    tried = np.concatenate([forest.candidates(t, np.arange(1, 500), 20, 1) for t in range(8)])
    assert tried.shape[1] == 4 and all(len(set(r)) == 4 for r in tried.tolist())
    assert np.bincount(tried.ravel(), minlength=20).min() > 0.8 * len(tried) * 4 / 20


def test_model_that_is_asked_for_is_the_one_that_scores(spark):
    """Scores and labels of the exports come from the same kind of model; too small a subject has neither scores nor importances."""
    rng = np.random.default_rng(6)
    wave = [(f"{i}", 1767225600 + 300 * k, float(130 + 70 * np.sin(4 * np.pi * k / 288) + rng.normal(0, 15)), k) for i, n in (("A", 288 * 4), ("B", 40)) for k in range(n)]
    ex = R.examples(spark.createDataFrame(wave, "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")).cache()
    forest_params, logistic = PredictiveParams(model="random_forest", trees=30), PredictiveParams()
    found = {}
    for params, label in ((forest_params, "Random forest"), (logistic, "Logistic regression")):
        scores, perf, importance = E.complete_predictive(ex, params)
        assert [r["Model"] for r in perf.collect()] == [label] and {r["Model"] for r in importance.collect()} == {label} and {r["Subject ID"] for r in importance.collect()} == {"A"}
        assert perf.first()["AUC"] > 0.85 and scores.count() == ex.count() and scores.where("`Subject ID` = 'B' and `Risk probability` is not null").count() == 0
        found[label] = {(r["Subject ID"], r["Timestamp"]): r["Risk probability"] for r in scores.collect()}
    apart = [abs(v - found["Logistic regression"][k]) for k, v in found["Random forest"].items() if v is not None]
    assert max(apart) > 0.05 and all(0 <= v <= 1 for v in found["Random forest"].values() if v is not None)


def test_no_subject_with_enough_rows(spark):
    ex = R.examples(spark.createDataFrame([], "id string, timestamp timestamp, glucose double, _ord long"))
    for model in ("logistic", "random_forest"):
        scores, importance = R.per_subject_models(ex, PredictiveParams(model=model))
        assert scores.count() == 0 and importance.count() == 0

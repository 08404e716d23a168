"""State-space smoothing and nearest days against dense linear algebra and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucolake.operators import imputation as I
from glucolake.operators import smoothing as S


def dense(y, q, r):
    """The mean of all levels given the readings, from the joint normal distribution of states and readings."""
    n = len(y)
    first = y[np.isfinite(y)][0]
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    mean, cov = [], np.zeros((2 * n, 2 * n))
    m, p = np.array([first, 0.0]), np.diag(S.WIDE)
    for t in range(n):
        m = step @ m
        p = step @ p @ step.T + np.diag([0.0, q])
        mean.append(m)
        cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2] = p
        for u in range(t + 1, n):
            cov[2 * u : 2 * u + 2, 2 * t : 2 * t + 2] = step @ cov[2 * u - 2 : 2 * u, 2 * t : 2 * t + 2]
            cov[2 * t : 2 * t + 2, 2 * u : 2 * u + 2] = cov[2 * u : 2 * u + 2, 2 * t : 2 * t + 2].T
    level = np.arange(n) * 2
    seen = np.flatnonzero(np.isfinite(y))
    mean = np.array(mean)[:, 0]
    known = cov[np.ix_(level[seen], level[seen])] + r * np.eye(len(seen))
    return mean + cov[np.ix_(level, level[seen])] @ np.linalg.solve(known, y[seen] - mean[seen])


def series(seed, n, holes=0.3):
    rng = np.random.default_rng(seed)
    y = 130 + np.cumsum(np.cumsum(rng.normal(0, 0.6, n)) * 0.2) + rng.normal(0, 4, n)
    y[rng.random(n) < holes] = np.nan
    y[20:35] = np.nan  # more than a day of ten slots
    y[0] = 131.0
    return y


def rows_of(y, subject, per_day):
    y = np.r_[y, np.full(-len(y) % per_day, np.nan)].reshape(-1, per_day)
    return [(subject, k, row.tolist()) for k, row in enumerate(y)]


def test_smoother_over_days_equals_that_of_the_whole_series(spark):
    a, b = series(1, 95), series(2, 60)
    days = spark.createDataFrame(rows_of(a, "A", 10) + rows_of(b, "B", 10), "id string, day long, y array<double>").repartition(5)
    parameters = spark.createDataFrame([("A", 0.4, 16.0), ("B", 2.5, 0.5)], "id string, q double, r double")
    got = {}
    for r in S.kalman(days, parameters).collect():
        got.setdefault(r["id"], {})[r["day"]] = r["values"]
    for name, y, q, r in (("A", a, 0.4, 16.0), ("B", b, 2.5, 0.5)):
        flat = np.concatenate([got[name][k] for k in sorted(got[name])])[: len(y)]
        assert flat == pytest.approx(dense(y, q, r), abs=1e-4)


def test_noise_by_moments(spark):
    rng = np.random.default_rng(3)
    q, r, n = 0.5, 9.0, 20_000
    y = np.cumsum(np.cumsum(rng.normal(0, q**0.5, n))) + rng.normal(0, r**0.5, n)
    days = spark.createDataFrame(rows_of(y, "A", 200), "id string, day long, y array<double>")
    row = S.noise(days).first()
    assert row["n"] == n and row["r"] == pytest.approx(r, rel=0.05) and row["q"] == pytest.approx(q, rel=1.0) and row["q"] > 0


def plain_knn(y, per_day, k, window):
    days = {d: row for d, row in enumerate(np.r_[y, np.full(-len(y) % per_day, np.nan)].reshape(-1, per_day))}
    out = {}
    for d, row in days.items():
        near = []
        for e, other in days.items():
            both = np.isfinite(row) & np.isfinite(other)
            if 0 < abs(d - e) <= window and both.sum() >= max(1, per_day // S.LEAST_SHARE):
                near.append((round(float(np.sqrt(((row - other)[both] ** 2).mean())), 9), e))
        near.sort()
        for slot in np.flatnonzero(~np.isfinite(row)):
            values = [days[e][slot] for _, e in near if np.isfinite(days[e][slot])][:k]
            if values:
                out[d, int(slot)] = float(np.mean(values))
    return out


def test_nearest_days_equal_plain_loops(spark):
    y = series(5, 400, 0.25) + np.tile(np.linspace(-30, 30, 20), 20)
    days = spark.createDataFrame(rows_of(y, "A", 20), "id string, day long, y array<double>")
    got = {(r["day"], k): v for r in S.knn(days, 20, 3, 4).collect() for k, v in enumerate(r["values"]) if not np.isnan(v)}
    want = plain_knn(y, 20, 3, 4)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(v, abs=1e-9) for x, v in want.items())


def readings(spark, y, subject="A", minutes=5):
    return spark.createDataFrame([(subject, 1767225600 + 60 * minutes * k, float(v), k, "s") for k, v in enumerate(y) if np.isfinite(v)], "id string, s long, glucose double, _ord long, id_source string").select("id", "id_source", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")


def test_models_have_estimators_of_their_own(spark):
    """What each fills in a wave with a gap: the smoother bends, the nearest days know the hour, and observed rows stay."""
    t = np.arange(288 * 4)
    wave = 150 + 40 * np.sin(2 * np.pi * t / 288)
    y = wave + np.random.default_rng(1).normal(0, 1, len(t))
    y[288 * 2 + 40 : 288 * 2 + 80] = np.nan
    df = readings(spark, y).unionByName(readings(spark, np.r_[100, np.full(3, np.nan), 120], "B"))
    off = {}
    for model in ("linear", "kalman", "knn"):
        rows = I.impute(df, model).where("id = 'A'").orderBy("slot").collect()
        assert {r["imputation_estimator"] for r in rows} == {model} and sum(r["imputed_flag"] for r in rows) == 40
        assert all(r["glucose"] == y[r["slot"]] for r in rows if not r["imputed_flag"]) and {r["imputation_error"] for r in rows} == {None}
        off[model] = float(np.sqrt(np.mean([(r["glucose"] - wave[r["slot"]]) ** 2 for r in rows if r["imputed_flag"]])))
    assert off["knn"] < 2 and off["kalman"] != off["linear"] and off["kalman"] < 25
    for model in ("kalman", "knn"):
        few = I.impute(df, model).where("id = 'B'").collect()
        assert not any(r["imputed_flag"] for r in few) and {r["imputation_error"] for r in few} == {"Needs at least 20 readings; has 2."} and sum(r["glucose"] is None for r in few) == 3
    assert I.impute(df.where("false"), "kalman").count() == 0

"""Bases of daily profiles, the spline that takes their place, and components of incomplete curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucolake.config import FunctionalParams
from glucolake.operators import functional as FN

FOURIER = FunctionalParams(basis="fourier", smoothing=1e-6)


def test_fourier_basis_is_orthonormal_with_its_derivatives():
    b, d1, d2, penalty = FN.fourier(1, 7)
    assert b.shape == (1440, 7) and b.T @ b == pytest.approx(np.eye(7), abs=1e-9)
    ahead = np.roll(b, -1, axis=0) - np.roll(b, 1, axis=0)
    assert d1 == pytest.approx(ahead / 2, abs=1e-5) and d2 == pytest.approx(np.roll(b, -1, 0) - 2 * b + np.roll(b, 1, 0), abs=1e-7)
    assert penalty == pytest.approx(d2.T @ d2, abs=1e-12)
    assert FN.fourier(5, 8)[0].shape[1] == 7


def test_fourier_fit_gives_value_rate_and_acceleration():
    t = np.arange(0, 1440, 5)
    w = 2 * np.pi / 1440
    y = 120 + 30 * np.sin(w * t) - 10 * np.cos(2 * w * t)
    keep = np.r_[0:100, 140:288]  # a gap of over three hours
    value, rate, acceleration = FN.smooth(t[keep], y[keep], FOURIER)
    assert value == pytest.approx(y, abs=0.01)
    assert rate == pytest.approx(60 * (30 * w * np.cos(w * t) + 20 * w * np.sin(2 * w * t)), abs=0.05)
    assert acceleration == pytest.approx(3600 * (-30 * w**2 * np.sin(w * t) + 40 * w**2 * np.cos(2 * w * t)), abs=0.1)


def test_smoothing_spline_takes_the_penalty_of_least_gcv():
    """Against the fit solved anew for every penalty; the spline goes through its fitted values, with matching derivatives."""
    rng = np.random.default_rng(1)
    params = FunctionalParams(grid_minutes=10)
    slots = np.sort(rng.choice(144, 50, replace=False))
    y = 120 + 40 * np.sin(slots / 20) + rng.normal(0, 8, 50)
    value, rate, acceleration = FN.smoothing_spline(slots * 10, y, params)
    h = np.diff(slots).astype(float)
    q, r = np.zeros((50, 48)), np.zeros((48, 48))
    for j in range(48):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j < 47:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    k = q @ np.linalg.inv(r) @ q.T
    scale = np.linalg.eigvalsh(k)[-1]
    found = []
    for penalty in np.logspace(-6, 9, 91) / scale:
        hat = np.linalg.inv(np.eye(50) + penalty * k)
        left = y - hat @ y
        if 50 - np.trace(hat) > 1e-6 * 50:
            found.append((50 * left @ left / (50 - np.trace(hat)) ** 2, hat @ y))
    want = min(found, key=lambda x: x[0])[1]
    assert value[slots] == pytest.approx(want, abs=1e-5)
    inner = np.arange(slots[0] + 2, slots[-1] - 2)
    assert rate[inner] == pytest.approx((value[inner + 1] - value[inner - 1]) / 2 * 6, abs=2.0)
    assert np.allclose(acceleration[: slots[0]], 0) and rate[0] == pytest.approx(rate[slots[0]])
    outside = value[: slots[0] + 1]
    assert np.diff(outside, 2) == pytest.approx(np.zeros(max(0, len(outside) - 2)), abs=1e-9)


def day_readings(spark, subjects="A", days=2):
    rows = [(i, 1767225600 + 86400 * d + 300 * k, 120 + 25.0 * np.sin(2 * np.pi * k / 288 + ord(i)), k) for i in subjects for d in range(days) for k in range(288)]
    return spark.createDataFrame([(i, s, float(g), k) for i, s, g, k in rows], "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")


@pytest.mark.parametrize("basis", ["fourier", "smoothing_spline"])
def test_day_curves_in_other_bases(spark, basis):
    days = FN.day_curves(day_readings(spark), FunctionalParams(basis=basis))
    assert days.count() == 2 * 288 and days.where("smoothing_status = 'ok' and smoothing_note = ''").count() == 2 * 288
    assert days.agg(F.max(F.abs(F.col("smoothed_glucose") - F.col("raw_glucose")))).first()[0] < 0.6


def test_fallback_is_told(spark):
    """A penalty that is no number can't be fitted: the smoothing spline takes over and says so."""
    days = FN.day_curves(day_readings(spark), FunctionalParams(smoothing=float("nan")))
    row = days.first()
    assert row["smoothing_status"] == "fallback" and row["smoothing_note"].startswith("Basis smoothing failed") and row["smoothed_glucose"] == pytest.approx(row["raw_glucose"], abs=1)
    with pytest.raises(ValueError, match="basis is"):
        FunctionalParams(basis="wavelet")


def frame(spark, curves):
    rows = [(f"s{i:02d}", 60 * k, float(v)) for i, c in enumerate(curves) for k, v in enumerate(c) if np.isfinite(v)]
    return spark.createDataFrame(rows, "id string, time_minutes int, mean_glucose double")


def test_scores_of_whole_curves_are_projections(spark):
    rng = np.random.default_rng(2)
    curves = 120 + rng.normal(0, 20, (9, 1)) * np.sin(np.arange(24) / 4) + rng.normal(0, 8, (9, 1)) * np.cos(np.arange(24) / 3) + rng.normal(0, 1, (9, 24))
    got = {r["id"]: (r["fpca1"], r["fpca2"]) for r in FN.fpca_scores(frame(spark, curves).repartition(4), FunctionalParams(grid_minutes=60)).collect()}
    u, s, v = np.linalg.svd(curves - curves.mean(axis=0))
    for k in (0, 1):
        sign = 1 if v[k][np.abs(v[k]).argmax()] >= 0 else -1
        assert [got[f"s{i:02d}"][k] for i in range(9)] == pytest.approx((sign * (u[:, : len(s)] * s)[:, k]).tolist(), abs=1e-6)


def test_scores_of_incomplete_curves_are_near_those_of_whole_ones(spark):
    """Curves of two components with slots missing, some by the hour for nearly all: everyone has scores, close to what the whole curve gives."""
    rng = np.random.default_rng(3)
    params = FunctionalParams(grid_minutes=60)
    curves = 120 + rng.normal(0, 25, (60, 1)) * np.sin(np.arange(24) * np.pi / 12) + rng.normal(0, 10, (60, 1)) * np.cos(np.arange(24) * np.pi / 6)
    whole = {r["id"]: r for r in FN.fpca_scores(frame(spark, curves), params).collect()}
    holes = curves.copy()
    holes[rng.random(curves.shape) < 0.3] = np.nan
    holes[1:, 5] = np.nan  # only one curve has this slot, so no pair with it has a covariance
    holes[7] = np.nan
    holes[7, [3, 9, 15]] = curves[7, [3, 9, 15]]
    got = {r["id"]: r for r in FN.fpca_scores(frame(spark, holes), params).collect()}
    assert got.keys() == whole.keys()
    for name in ("fpca1", "fpca2"):
        a, b = (np.array([x[k][name] for k in sorted(x)]) for x in (got, whole))
        assert np.corrcoef(a, b)[0, 1] > 0.97


def test_covariance_over_pairs(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(120, 30, (12, 6))
    y[rng.random(y.shape) < 0.3] = np.nan
    rows = spark.createDataFrame([(f"s{i}", r.tolist()) for i, r in enumerate(y)], "id string, y array<double>").repartition(3)
    mean, covariance = FN.mean_and_covariance(rows, 6)
    assert mean == pytest.approx(np.nanmean(y, axis=0))
    for i in range(6):
        for j in range(6):
            both = np.isfinite(y[:, i]) & np.isfinite(y[:, j])
            assert covariance[i, j] == pytest.approx(((y[both, i] - mean[i]) * (y[both, j] - mean[j])).sum() / (both.sum() - 1))


def test_one_subject_has_no_scores(spark):
    assert FN.fpca_scores(frame(spark, [np.full(24, 100.0)]), FunctionalParams(grid_minutes=60)).first()["fpca1"] is None


def test_feature_tables_and_warning(spark):
    """Headings, groups, rounding half to even, and the text of days left out; a subject without group, nulls, empty tables."""
    schema = "id string, days int, valid_fda_days long, peak_time string, peak_glucose double, area_above double, max_rise_rate double, fpca1 double, phenotype_group string"
    rows = [("a", 2, 1, "08:05", 180.125, 3.5, 0.375, 1.0, "P1"), ("b", 1, 1, None, None, None, -2.346, None, None)]
    f = spark.createDataFrame(rows, schema)
    groups = spark.createDataFrame([("a", "x")], "id string, group string")
    d = FN.features_display(f, groups)
    assert d.columns == ["Subject ID", "Days", "Valid FDA days", "Peak time", "Peak glucose", "Area above range (mg/dL-hour)", "Max rise rate (mg/dL/hour)", "FPCA 1", "Phenotype group", "Group"]
    k = FN.key_features(f, groups)
    assert k.columns == ["Subject ID", "Group", "Days", "Valid FDA days", "Peak time", "Peak glucose", "Max rise rate (mg/dL/hour)", "Phenotype group"]
    assert sorted(map(tuple, k.collect())) == [("a", "x", 2, 1, "08:05", 180.12, 0.38, "P1"), ("b", None, 1, 1, None, None, -2.35, None)]
    assert FN.key_features(f, show_id=False).columns[0] == "Days" and FN.key_features(f.where("false")).count() == 0
    days = spark.createDataFrame([("a", "d1", "invalid"), ("a", "d1", "invalid"), ("a", "d2", "complete"), ("b", "d1", None)], "id string, date string, smoothing_status string")
    says = "1 of 3 FDA day profile(s) were excluded after smoothing produced implausible values outside 0-500 mg/dL."
    assert [r[0] for r in FN.smoothing_warning(days).collect()] == [says]
    assert [r[0] for r in FN.smoothing_warning(days.where("id = 'b'")).collect()] == [""] == [r[0] for r in FN.smoothing_warning(days.where("false")).collect()]

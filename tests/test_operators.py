"""Operators on small literal tables with known answers, and pairs of forms that must agree."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucolake.config import ComplexityParams, FunctionalParams, PredictiveParams, Settings, Thresholds, interval
from glucolake.functions.columns import numbered_in_order, with_sum_below
from glucolake.operators import complexity as C
from glucolake.operators import downsample as D
from glucolake.operators import export as E
from glucolake.operators import functional as FN
from glucolake.operators import imputation as I
from glucolake.operators import metrics as M
from glucolake.operators import missingness as G
from glucolake.operators import predictive as R
from glucolake.operators import quality as Q
from glucolake.operators import scope as S
from glucolake.operators import stats as T
from glucolake.plans.queries import QUERIES


def table(spark, rows, group="g"):
    """Rows of (id, 'HH:MM' or full time, glucose)."""
    full = [(i, t if t is None or len(t) > 8 else f"2026-01-01 {t}", None if g is None else float(g), group, k) for k, (i, t, g) in enumerate(rows)]
    return spark.createDataFrame(full, "id string, t string, glucose double, group string, _ord long").select("id", F.to_timestamp("t").alias("timestamp"), "glucose", "group", "_ord")


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first()


def series(spark, values, minutes=5, id="A"):
    start = 1767225600
    rows = [(id, start + 60 * minutes * i, float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", F.lit("g").alias("group"), "_ord")


def test_core_metrics(spark):
    df = table(spark, [("A", "08:00", 60), ("A", "08:05", 100), ("A", "08:10", 150), ("A", "08:15", 220)])
    m = M.core_metrics(df)
    r = one(m, metric_period="full_day")
    assert (r["readings"], r["tir_percent"], r["tbr_percent"], r["tar_percent"]) == (4, 50, 25, 25)
    assert {x["metric_period"] for x in m.collect()} == {"full_day", "daytime"}


def test_periods_and_time_windows(spark):
    df = table(spark, [("A", "01:00", 1), ("A", "05:59:59", 2), ("A", "06:00:00", 3), ("A", "23:59:59", 4), ("A", "00:00", 5), ("A", None, 6)])
    n = {r["metric_period"]: r["readings"] for r in M.base_metrics(M.with_periods(df)).collect()}
    assert n == {"full_day": 6, "daytime": 2, "nighttime": 3}
    assert S.filter_time_window(df, "night").count() == 3 and S.filter_time_window(df, "Full day").count() == 6
    assert S.filter_dates(df).count() == 6 and S.filter_dates(df, "2026-01-01").count() == 5


def test_all_null_group_has_a_row(spark):
    r = M.base_metrics(table(spark, [("A", "01:00", None)]), keys=["id"]).first()
    assert r["readings"] == 0 and r["mean_glucose"] is None and r["tir_percent"] is None


def test_qc(spark):
    df = table(spark, [("A", "08:00", 100), ("A", "08:05", 110), ("A", "08:05", 500), ("A", "08:30", None)])
    s = Q.qc_summary(df)
    r = s.first()
    assert (r["readings"], r["duplicate_timestamps"], r["missing_glucose"], r["implausible_values"], r["gap_count"]) == (4, 1, 1, 1, 1)
    note = Q.qc_review(s).first()
    assert note["qc_status"] == "Review" and all(x in note["review_notes"] for x in ("1 missing", "1 timestamp gap", "1 duplicate", "outside review range"))
    full = Q.qc_review(Q.qc_summary(table(spark, [("B", f"{h:02d}:00", 100) for h in range(24)]))).first()
    assert (full["qc_status"], full["review_notes"]) == ("OK", "No review flags")
    empty = Q.qc_summary(table(spark, [("C", None, 1), ("C", None, None)])).first()
    assert empty["readings"] == 2 and empty["median_interval_minutes"] is None and empty["wear_time_percent"] is None


def test_grid_counts(spark):
    df = table(spark, [("GAP001", f"{h:02d}:00", None if h == 3 else 100) for h in [*range(14), *range(16, 24)]] + [("GAP002", f"{h:02d}:00", None if h == 6 else 100) for h in range(24)])
    got = {r["id"]: (r["missing_glucose"], r["explicit_missing_glucose"], r["estimated_missing_readings"], r["missing_glucose_rate"]) for r in G.grid_summary(df, 60).collect()}
    assert got == {"GAP001": (3, 1, 2, 12.5), "GAP002": (1, 1, 0, 4.17)}
    gap = G.gap_periods(df, 60).first()
    assert (gap["gap_minutes"], gap["estimated_missing_readings"]) == (120, 2)


def test_gap_islands_snap_and_mixed(spark):
    df = table(spark, [("A", "00:00", 1), ("A", "00:05", None), ("A", "00:10", 2), ("A", "00:30", 3)])
    r = G.grid_summary(df).first()
    assert (r["explicit_missing_glucose"], r["estimated_missing_readings"], r["missing_glucose"]) == (1, 3, 4)
    df = table(spark, [("A", "00:00", 100), ("A", "00:04", None), ("A", "00:06", 115), ("A", "00:15", 120)])
    grid = [(r["slot"], r["glucose"]) for r in G.regular_grid(df).orderBy("slot").collect()]
    assert grid == [(0, 100), (1, 115), (2, None), (3, 120)]
    assert G.grid_summary(df).first()["missing_glucose_rate"] == 25


@pytest.mark.parametrize("seed", range(3))
def test_counted_grid_equals_made_grid(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, f"2026-01-0{d} {h:02d}:{m:02d}:{s:02d}", None if rng.random() < 0.2 else 100) for i in "AB" for d, h, m, s in zip(rng.integers(1, 4, 60), rng.integers(0, 24, 60), rng.integers(0, 60, 60), rng.integers(0, 60, 60), strict=True)]
    df = table(spark, [*rows, ("", "01:00", None), (None, "01:00", 5), ("A", None, None)])
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(G.grid_summary(df, 30)) == key(G.grid_summary_of(G.regular_grid(df, 30)))


def test_calendar(spark):
    df = table(spark, [("A", f"2026-01-0{d} 0{h}:00", 100) for d in (1, 3) for h in range(3)])
    c = G.coverage_calendar(df, 60).orderBy("date").collect()
    assert [r["readings"] for r in c] == [3, 0, 3] and c[0]["coverage_percent"] == 12.5
    assert [r["missing_glucose"] for r in c][1] == 24 and c[1]["coverage_status"] == "No data"
    w = G.day_warnings(G.coverage_calendar(df, 60)).first()
    assert (w["full_missing_days"], w["half_day_or_worse_days"]) == (1, 2)


def test_study_window(spark):
    df = table(spark, [("A", "2026-01-01 00:00", 1), ("A", "2026-01-10 00:00", 1), ("", "2026-01-10 00:00", 1)])
    assert tuple(S.study_window(df, 14).first())[3:] == (10, 14, 4, "Short observed span")
    assert S.study_window(df).first()["status"] == "No expected duration set"


def test_lag_metrics_on_regular_series_equal_positions(spark):
    x = [120 + 20 * math.sin(i / 9) + (i % 2) * 12 for i in range(576)]
    r = M.lag_metrics(series(spark, x), ["id"]).first()
    x = np.array(x)
    assert r["conga_12h"] == pytest.approx((x[144:] - x[:-144]).std(ddof=1)) and r["conga_24h"] == pytest.approx((x[288:] - x[:-288]).std(ddof=1)) and r["modd"] == pytest.approx(np.abs(x[288:] - x[:-288]).mean())


def test_lag_metrics_of_dense_series_meet_each_reading_twice(spark):
    rng = np.random.default_rng(3)
    # Times close together and equal, a day without a reading, a second group; every wanted time has many readings within the tolerance.
    days = {"A": (0, 1, 3, 4), "B": (0, 1)}
    at = {i: np.sort(np.concatenate([d * 86400 + rng.integers(0, 3600, 60) for d in ds] + [d * 86400 + 43200 + rng.integers(0, 3600, 60) for d in ds])) for i, ds in days.items()}
    x = {i: [float(v) for v in rng.integers(50, 300, len(t))] for i, t in at.items()}
    rows = [(i, 1767225600 + int(t), v, k) for i in at for k, (t, v) in enumerate(zip(at[i], x[i], strict=True))]
    df = spark.createDataFrame(rows, "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")
    out = M.lag_metrics(df, ["id"])
    got = {r["id"]: r for r in out.collect()}
    for i, t in at.items():
        gap = np.diff(t)
        tolerance = max(60, 0.51 * np.median(gap[gap > 0]))
        diff = {}
        for lag in (43200, 86400):
            found = [(min((abs(u - a - lag), u, v) for u, v in zip(t, x[i], strict=True)), b) for a, b in zip(t, x[i], strict=True)]
            diff[lag] = np.array([v - b for (apart, _, v), b in found if apart <= tolerance])
        assert [got[i][c] for c in ("conga_12h", "conga_24h", "modd")] == pytest.approx([diff[43200].std(ddof=1), diff[86400].std(ddof=1), np.abs(diff[86400]).mean()])
    # No join by time: only tables of a row a group or a part of its days are joined.
    assert "bucket" not in out._jdf.queryExecution().optimizedPlan().toString() and "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_templates_of_whole_series_are_compared_once(spark, monkeypatch):
    sizes, stored = {}, C.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(C, "stored", counted)
    x = np.repeat(np.random.default_rng(2).integers(60, 250, 30).astype(float), 20)
    params = ComplexityParams(thin_to=None, scales=2)
    got = {r["scale"]: r["sample_entropy"] for r in C.mse(series(spark, x), params).collect()}
    for scale in (1, 2):
        coarse = x.reshape(-1, scale).mean(axis=1)
        assert got[scale] == pytest.approx(C.sample_entropy(coarse, params.embedding, params.tolerance * coarse.std(ddof=1)), abs=1e-12)
    assert sizes["templates"] <= 2 * 3 * 30  # of 596 and 298 templates


def test_mage_and_risk(spark):
    x = [100, 180, 90, 200, 80, 85, 84, 160]
    ext = [180, 90, 200, 80, 85, 84]
    sd = np.std(x, ddof=1)
    steps = [abs(a - b) for a, b in zip(ext, ext[1:], strict=False)]
    assert M.mage(series(spark, x), ["id"]).first()["mage"] == pytest.approx(np.mean([s for s in steps if s >= sd]))
    f = [1.509 * (math.log(g) ** 1.084 - 5.381) for g in x]
    r = M.risk_metrics(series(spark, x), ["id"]).first()
    assert r["lbgi"] == pytest.approx(sum(10 * v * v for v in f if v < 0) / 8) and r["hbgi"] == pytest.approx(sum(10 * v * v for v in f if v > 0) / 8)


def test_display_and_agp(spark):
    long = M.metrics_long(M.base_metrics(M.with_periods(series(spark, range(100, 400)))))
    assert long.select("raw_name").distinct().count() == 15 and M.summary_cards(long).count() == 6
    assert M.agp(series(spark, [100] * 288)).count() == 48
    assert [r["n"] for r in M.agp(series(spark, [100] * 12), 60).collect()] == [12]


def test_statistics(spark):
    m = spark.createDataFrame([(f"s{i}", "Control" if i < 4 else "Treatment", float(v), "full_day") for i, v in enumerate([100, 105, 110, 120, 140, 142, 145, 150])], "id string, group string, mean_glucose double, metric_period string")
    means = {r["group"]: (r["n"], r["mean"]) for r in T.group_summary(m, "mean_glucose").collect()}
    assert means == {"Control": (4, 108.75), "Treatment": (4, 144.25)}
    r = T.compare_groups(m, "mean_glucose").first()
    assert r["n"] == "4 / 4" and r["statistic"] == pytest.approx((108.75 - 144.25) / math.sqrt((218.75 / 3 + 56.75 / 3) / 4)) and 0 < r["p_value"] < 0.01
    w = T.compare_groups(m, "mean_glucose", test="wilcoxon").first()
    assert w["statistic"] == 0 and w["p_value"] == pytest.approx(0.0304, abs=1e-3)
    assert "exactly two" in T.compare_groups(m.where("group = 'Control'"), "mean_glucose").first()["note"]
    assert T.grouping_columns(m) == ["group"]
    assert T.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and T.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_complexity_kernels(spark):
    rng = np.random.default_rng(0)
    x = 120 + 20 * np.sin(np.arange(180) / 5) + rng.normal(size=180)
    df = series(spark, x, 15)
    assert C.dfa_windows(180) == [10, 13, 16, 21, 27, 35, 44] and C.dfa_windows(31) == [] and C.dfa_windows(32) == []
    y = np.cumsum(x - x.mean())
    want = {w: math.sqrt(np.mean([np.mean((s - np.polyval(np.polyfit(np.arange(w), s, 1), np.arange(w))) ** 2) for s in y[: 180 // w * w].reshape(-1, w)])) for w in C.dfa_windows(180)}
    assert {r["scale"]: r["fluctuation"] for r in C.dfa(df).collect()} == pytest.approx(want)
    want = {k: np.mean([np.abs(np.diff(x[m::k])).sum() * 179 / (len(x[m::k][1:]) * k) for m in range(k)]) for k in range(1, 9)}
    assert {r["scale"]: r["curve_length"] for r in C.higuchi(df).collect()} == pytest.approx(want)
    flat = series(spark, [100] * 180)
    assert C.dfa(flat).count() == C.higuchi(flat).count() == C.hurst(flat).count() == C.mse(flat).count() == 0
    assert C.shannon(flat).first()["shannon_entropy"] == 0


def test_sample_entropy_equals_pairs():
    rng = np.random.default_rng(1)
    x, m, r = rng.normal(size=60), 2, 0.5
    a = b = 0
    for i in range(60 - m):
        for j in range(i + 1, 60 - m):
            if max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r:
                b += 1
                a += abs(x[i + m] - x[j + m]) <= r
    assert C.sample_entropy(x, m, r) == pytest.approx(-math.log(a / b))


def test_hurst_orders_persistence(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=2048)
    walk = np.cumsum(noise)
    h = {n: C.hurst(series(spark, 100 + v)).first()["hurst"] for n, v in (("white", noise), ("walk", walk), ("anti", np.diff(noise, append=0)))}
    assert h["anti"] < h["white"] < h["walk"] and abs(h["white"] - 0.5) < 0.12


def rescaled_ranges(x):
    """Mean R/S for each segment length, segment by segment."""
    out = {}
    for scale in C.hurst_windows(len(x)):
        found = []
        for seg in np.asarray(x, float)[: len(x) // scale * scale].reshape(-1, scale):
            z = np.cumsum(seg - seg.mean())
            if seg.min() < seg.max():
                found.append((z.max() - z.min()) / seg.std())
        if found:
            out[scale] = np.mean(found)
    return out


@pytest.mark.parametrize("n", [15, 16, 37, 1000, 1024, 2500, 5001])
def test_hurst_of_any_length_and_with_flat_stretches(spark, n):
    """Segments within blocks, over their ends and over many blocks give what plain loops do; constant ones count for nothing."""
    x = 100 + np.random.default_rng(n).integers(0, 200, n) / 10
    x[n // 3 : n // 3 + n // 5] = 110.3
    rs = rescaled_ranges(x)
    got = C.hurst(series(spark, x)).collect()
    if len(rs) < 2:
        assert [r["hurst"] for r in got] == [None] * len(rs)
        return
    want = 0.5 + np.polyfit(np.log(list(rs)), [math.log(v) - math.log(C.expected_range(s)) for s, v in rs.items()], 1)[0]
    assert got[0]["hurst"] == pytest.approx(want, abs=1e-9) and len(got) == 1


def test_hurst_repeats_no_reading_by_scale(spark, monkeypatch):
    """What is stored and shuffled besides the readings, once each, is a few rows a block and scale."""
    rows, stored = {}, C.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(C, "stored", counted)
    x = np.random.default_rng(3).normal(120, 20, 20_000)
    assert C.hurst(series(spark, x)).count() == 1
    assert rows["blocks"] == 20 and rows["parts"] <= 20 * len(C.hurst_windows(20_000)) * 3


def test_functional(spark):
    rows = [(i, d, k) for i in "AB" for d in range(1, 4) for k in range(288)]
    df = spark.createDataFrame([(i, f"2026-01-0{d}", k, 115 + 25 * math.sin(2 * math.pi * k / 288) + 12 * (i == "B")) for i, d, k in rows], "id string, d string, k int, glucose double")
    df = df.select("id", F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("d")) + F.col("k") * 300).alias("timestamp"), "glucose", F.monotonically_increasing_id().alias("_ord"))
    days = FN.day_curves(df)
    assert days.count() == 6 * 288 and days.where("smoothing_status <> 'ok'").count() == 0
    assert days.agg(F.max(F.abs(F.col("smoothed_glucose") - F.col("raw_glucose")))).first()[0] < 1
    b = FN.profile_bundle(df)
    f = {r["id"]: r for r in b["features"].collect()}
    assert abs(f["A"]["peak_minutes"] - 360) <= 30 and f["B"]["peak_glucose"] > f["A"]["peak_glucose"] and f["A"]["valid_fda_days"] == 3
    assert FN.day_curves(df, FunctionalParams(grid_minutes=10)).where("id = 'A' and date = '2026-01-01'").count() == 144
    assert FN.day_curves(df, FunctionalParams(high=120)).where("smoothing_status = 'invalid'").where("smoothed_glucose is not null").count() == 0


def test_bundle_equals_its_parts(spark):
    """One grid for all gives what each makes from a grid of its own."""
    df = table(spark, [("A", "00:00", 1), ("A", "00:04", None), ("A", "00:30", 3), ("A", "2026-01-03 00:01:00", 4), ("B", "10:00", 5), ("B", "11:00", None), ("B", "14:00", 7)])
    rows = lambda d: sorted(map(str, d.collect()))
    b = G.bundle(df, 30)
    calendar = G.coverage_calendar(df, 30)
    for name, own in {"grid": G.regular_grid(df, 30), "summary": G.grid_summary(df, 30), "gaps": G.gap_periods(df, 30), "heatmap": G.daily_heatmap(df, 30), "calendar": calendar, "warnings": G.day_warnings(calendar)}.items():
        assert rows(b[name].select(*own.columns)) == rows(own) and own.count(), name
    b["grid"].unpersist(), b["heatmap"].unpersist()


def test_predictive(spark):
    x = [130 + 65 * math.sin(4 * math.pi * i / 288) for i in range(288 * 3)]
    ex = R.examples(series(spark, x).unionByName(series(spark, [v - 3 for v in x], id="B")))
    cols = R.feature_columns()
    assert set(cols) < set(ex.columns) and ex.where(" or ".join(f"{c} is null" for c in cols)).count() == 0
    row = one(ex.where("id = 'A'").orderBy("timestamp").limit(1))
    assert row["lag_5_glucose"] == pytest.approx(x[11]) and row["window_15_mean"] == pytest.approx(np.mean(x[10:13])) and row["target"] == int(min(x[13:19]) < 70)
    s = R.split(ex)
    assert s.select("id", "split").distinct().count() == s.select("id").distinct().count()
    found, why = R.fit_and_score(ex)
    assert not why and 0.5 < R.performance(found[0]).first()["auc"] <= 1
    assert R.fit_and_score(ex.limit(10))[0] is None
    assert PredictiveParams(horizon_minutes=50, threshold=3).normalized() == PredictiveParams(horizon_minutes=60, threshold=0.99)


def test_windows_by_day_equal_windows_by_subject(spark):
    rng = np.random.default_rng(5)
    at = np.sort(rng.choice(3 * 1440, 150, replace=False))
    at = at[(at < 1300) | (at > 2900)]  # a day without a reading
    df = spark.createDataFrame([("A", 1767225600 + int(m) * 60, float(v), k) for k, (m, v) in enumerate(zip(at, rng.uniform(50, 300, len(at)), strict=True))], "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")
    g = {r["timestamp"]: r["glucose"] for r in df.collect()}
    t = np.array([x.timestamp() / 60 for x in sorted(g)])
    v = np.array([g[x] for x in sorted(g)])
    for r in R.examples(df).collect():
        m = r["timestamp"].timestamp() / 60
        for k in (5, 15, 30, 60):
            assert r[f"lag_{k}_glucose"] == pytest.approx(np.interp(m - k, t, v))
        for w in (15, 30, 60):
            assert r[f"window_{w}_mean"] == pytest.approx(v[(t > m - w) & (t <= m)].mean())


def test_windows_of_dense_series_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    # Many readings a minute with equal times, runs of one value, two days that meet at midnight; a second subject on the same days.
    at = {"A": np.sort(np.r_[rng.integers(1300 * 60, 1520 * 60, 500), np.repeat(1440 * 60, 5)]), "B": np.sort(rng.integers(1380 * 60, 1500 * 60, 60))}
    g = {i: np.where(rng.random(len(t)) < 0.3, 100.0, np.round(rng.uniform(50, 300, len(t)), 2)) for i, t in at.items()}
    for i, t in at.items():
        g[i] = g[i][np.searchsorted(t, t)]  # equal times have equal values
    rows = [(i, 1767225600 + int(t), float(v), k) for i in at for k, (t, v) in enumerate(zip(at[i], g[i], strict=True))]
    df = spark.createDataFrame(rows, "id string, s long, glucose double, _ord long").select("id", F.timestamp_seconds("s").alias("timestamp"), "glucose", "_ord")
    for params in (PredictiveParams(), PredictiveParams(target="high", horizon_minutes=60, lag_minutes=(7,), window_minutes=(11, 50))):
        ex = R.examples(df, params)
        # A frame that moves with each row costs as many steps a row as there are rows in it.
        assert "specifiedwindowframe(RangeFrame" not in ex._jdf.queryExecution().executedPlan().toString()
        got = ex.collect()
        want = 0
        for i, t in at.items():
            for x in t:
                future = g[i][(t > x) & (t <= x + params.horizon_minutes * 60)]
                spans = [t[(t > x - w * 60) & (t <= x)] for w in params.window_minutes]
                want += bool(len(future) and x <= t[-1] - params.horizon_minutes * 60 and x - max(params.lag_minutes) * 60 >= t[0] and all(s[0] < x for s in spans))
        assert len(got) == want > 50
        for r in got:
            t, v, x = at[r["id"]], g[r["id"]], round(r["timestamp"].timestamp()) - 1767225600
            for k in params.lag_minutes:
                assert r[f"lag_{k}_glucose"] == pytest.approx(np.interp(x - k * 60, t, v))
            for w in params.window_minutes:
                near = v[(t > x - w * 60) & (t <= x)]
                first = np.searchsorted(t, x - w * 60, "right")
                measured = [r[f"window_{w}_{n}"] for n in ("mean", "sd", "min", "max", "slope")]
                assert measured == pytest.approx([near.mean(), near.std(ddof=1) if len(near) > 1 else 0, near.min(), near.max(), (r["glucose_current"] - v[first]) / ((x - t[first]) / 3600)], abs=1e-9)
            future = v[(t > x) & (t <= x + params.horizon_minutes * 60)]
            assert (r["future_points"], r["target_value"]) == (len(future), future.max() if params.target == "high" else future.min())


def test_imputation_fills_only_what_was_missing(spark):
    df = table(spark, [("A", "00:00", 100), ("A", "00:05", None), ("A", "00:20", 140), ("B", "00:00", 90), ("B", "00:05", 95), ("C", "00:00", None)])
    out = I.impute(df, "linear")
    got = {(r["id"], r["slot"]): (r["glucose"], r["imputed_flag"], r["group"]) for r in out.collect()}
    assert got[("A", 1)] == (110, True, "g") and got[("A", 2)] == (120, True, "g") and got[("A", 0)] == (100, False, "g") and got[("C", 0)] == (None, False, "g")
    c = {r["id"]: r["filled_glucose"] for r in G.compare(df, out).collect()}
    assert c == {"A": 3, "B": 0, "C": 0}
    assert {r["id"]: r["status"] for r in I.status(df, out).collect()} == {"A": "Complete", "B": "No missing glucose", "C": "Nothing filled"}
    outside = spark.createDataFrame([(1, 111.0), (0, 5.0), (5, float("nan"))], "_ord long, imputed_glucose double")
    r = {x["_ord"]: (x["glucose"], x["imputed_flag"]) for x in I.apply_result(df, outside).collect()}
    assert r[1] == (111, True) and r[0] == (100, False) and r[5] == (None, False)
    assert I.normalize_model("Random Forest") == "rf" and I.normalize_model("?") == "auto"


def test_lttb(spark):
    y = np.sin(np.arange(1, 101) / 10)
    k = D.lttb_indices(np.arange(1, 101.0), y, 10)
    assert k[0] == 0 and k[-1] == 99 and len(k) == 10 and (np.diff(k) > 0).all()
    assert list(D.lttb_indices(np.arange(2.0), np.arange(2.0), 10)) == [0, 1] and len(D.lttb_indices(np.zeros(0), np.zeros(0), 5)) == 0
    out = D.lttb(series(spark, 100 + 50 * np.sin(np.arange(2000) / 50)), 100)
    assert 90 <= out.count() <= 110
    assert D.thin_evenly(series(spark, range(1000)), 100).count() in range(99, 103)


def test_export(spark, tmp_path):
    df = table(spark, [("S 1/x", "08:00", 100)])
    assert E.plot_manifest(df).where("plot_type = 'agp'").first()["file_name"] == "cgm-agp-s-1-x.png"
    assert E.analysis_data(df).first()["timestamp"] == "2026-01-01T08:00:00"
    E.write_csv(E.analysis_data(df), str(tmp_path / "out"), single_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    assert '"tir_upper": 180.0' in Settings().to_json() and E.source_id("a/b.c.csv") == "b.c"
    with pytest.raises(ValueError):
        Thresholds(tir_lower=200)
    assert [interval(v) for v in (None, "x", 0, -1, 10, 7.9)] == [5, 5, 5, 5, 10, 7]


def test_notes_and_cached_exports(spark, tmp_path):
    df = table(spark, [("A", "08:00", 100), ("A", "08:00", 110), ("A", "09:00", 120), ("B", "08:00", 100), ("B", "09:00", 90)])
    note = one(Q.duplicate_note(Q.qc_summary(df)))
    assert (note["duplicate_timestamps"], note["affected_subjects"], note["message"]) == (1, 1, "1 duplicate timestamp(s) detected across 1 Subject ID(s). Review duplicate timestamps before final analysis if they are unexpected.")
    assert "across" not in one(Q.duplicate_note(Q.qc_summary(df), show_subjects=False))["message"] and Q.duplicate_note(Q.qc_summary(df.where("id = 'B'"))).count() == 0
    complete = E.complete_metrics(df)
    some = E.cached_metrics(M.core_metrics(df.where("id = 'A'")), df)
    rows = some.where("status is not null").collect()
    assert {(r["id"], r["group"], r["category"], r["metric"], r["status"], r["value"]) for r in rows} == {("A", "g", "Cache status", "Metrics cache status", "Generated", None), ("B", "g", "Cache status", "Metrics cache status", "Not generated", None)}
    assert some.where("status is null").count() == complete.where("id = 'A'").count() > 0
    curves = E.complete_complexity(df.where("id = 'B'"))
    assert {(r["id"], r["status"], r["metric"]) for r in E.cached_complexity(curves, df).where("status is not null").collect()} == {("A", "Not generated", "Complexity cache status"), ("B", "Generated", "Complexity cache status")}
    E.write_settings(Settings(), str(tmp_path / "log"), spark)
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == Settings().to_json()


def test_numbers_in_order(spark):
    keys = [f"k{i:04d}" for i in range(700)]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string").repartition(6)
    assert {r["k"]: r["n"] for r in numbered_in_order(df, "k", "n").collect()} == {k: i + 1 for i, k in enumerate(keys)}
    assert numbered_in_order(df.where("false"), "k", "n").count() == 0


def test_series_of_imputed_rows(spark):
    """A subject with an imputed or inserted row has a series of its own kind; the export tells by subject."""
    df = I.impute(table(spark, [("A", "00:00", 100), ("A", "00:20", 140), ("B", "00:00", 90), ("B", "00:05", 95)]), "linear")
    rows = {r["id"]: r for r in C.series_summary(df, ComplexityParams(min_points=3)).collect()}
    assert rows["A"]["series_mode"] == "imputed_regular" and rows["A"]["usable_points"] == 5 and rows["A"]["eligible"] and rows["A"]["note"] == "Eligible. " + C.SERIES_NOTES["imputed_regular"]
    assert rows["B"]["series_mode"] == "observed" and rows["B"]["interval_minutes"] == 5 and rows["B"]["note"] == "Needs at least 3 usable observed points. " + C.SERIES_NOTES["observed"]
    assert {(r["id"], r["time_basis"]) for r in E.complete_complexity(df).collect()} == {("A", C.TIME_BASES["imputed_regular"]), ("B", C.TIME_BASES["observed"])}


def test_metadata_that_varies_is_dropped(spark):
    df = table(spark, [("A", "01:00", 1), ("A", "02:00", 2)]).withColumn("site", F.col("_ord").cast("string")).withColumn("sex", F.lit("F"))
    m = M.attach_metadata(M.base_metrics(df, keys=["id"]), df, ["site", "sex"])
    assert "sex" in m.columns and "site" not in m.columns


def test_stream_equals_batch(spark, tmp_path):
    from glucolake.streaming import live

    df = series(spark, [100, 120, 90, 95, 130, 60] * 60).select("id", "timestamp", "glucose")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("tir", live.daily_time_in_range, "complete"), ("turns", live.turning_points, "append")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.table("tir").collect())) == sorted(map(tuple, live.daily_time_in_range(df).collect()))
    assert spark.table("turns").count() == 358 - 60 or spark.table("turns").count() > 200


def test_per_subject_scores_take_all_rows(spark):
    """Also of a subject above the rows of one task: same split, weights and scores, and none of its rows is lost."""
    rng = np.random.default_rng(8)
    wave = lambda n, low: [130 + low * math.sin(4 * math.pi * i / 288) + rng.normal(0, 15) for i in range(n)]
    ex = R.examples(series(spark, wave(288 * 5, 70)).unionByName(series(spark, wave(288 * 3, 65), id="B"))).cache()
    rows = lambda most: {(r["id"], r["timestamp"]): r for r in R.per_subject_scores(ex, most=most).collect()}
    whole, mixed, large = rows(10**6), rows(1000), rows(10)
    assert len(whole) == ex.count() and whole.keys() == mixed.keys() == large.keys()
    for other in (mixed, large):
        assert all(r["split"] == other[k]["split"] and r["target"] == other[k]["target"] and r["risk_probability"] == pytest.approx(other[k]["risk_probability"], abs=1e-6) for k, r in whole.items())
    for i in "AB":
        days = sorted({k[1].date() for k in whole if k[0] == i})
        test = days[-max(1, math.ceil(0.3 * len(days))) :]
        assert all(r["split"] == ("test" if k[1].date() in test else "train") for k, r in whole.items() if k[0] == i)
    few = R.per_subject_scores(ex.where("timestamp < '2026-01-01 03:00:00'"))
    assert few.count() > 0 and few.where("risk_probability is not null").count() == 0 and R.performance(few, by=("id",)).count() == 0


@pytest.mark.parametrize("n,test", [(2, 1), (3, 1), (4, 2), (7, 3), (10, 3), (11, 4)])
def test_split_sizes(spark, n, test):
    """A share of subjects or days, rounded up; of one day's rows, rounded down."""
    row = lambda i, day, k: (i, dt.datetime(2026, 1, day, 0, k), dt.date(2026, 1, day))
    frame = lambda rows: spark.createDataFrame(rows, "id string, timestamp timestamp, date date")
    assert R.split(frame([row(f"s{i}", 1, k) for i in range(n) for k in range(3)])).where("split = 'test'").select("id").distinct().count() == test
    got = R.split(frame([row("s", 1 + i, k) for i in range(n) for k in range(3)]))
    assert sorted(r["date"].day for r in got.where("split = 'test'").select("date").distinct().collect()) == list(range(n - test + 1, n + 1))
    got = R.split(frame([row("s", 1, k) for k in range(n)]))
    assert sorted(r["timestamp"].minute for r in got.where("split = 'test'").collect()) == list(range(n - max(1, int(0.3 * n)), n))


def test_gate_counts_all_examples_and_training_events():
    assert R.fit_status(79, 30, 30)[0] == "insufficient_examples" and R.fit_status(80, 5, 5)[0] == "ready"
    assert R.fit_status(80, 4, 60)[0] == R.fit_status(80, 60, 4)[0] == "insufficient_events" and R.fit_status(80, 0, 0)[0] == "insufficient_features"


def test_sums_below_equal_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [(str(g), float(v), int(n)) for g in range(3) for v, n in zip(np.unique(rng.normal(size=700).round(2)), rng.integers(1, 9, 700))]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    for by in ((), ("g",)):
        d = df if by else df.groupBy("v").agg(F.sum("n").alias("n"))
        got = {(r["g"] if by else "", r["v"]): r["below"] for r in with_sum_below(d, "v", "n", by, 16).collect()}
        all_rows = [tuple(r) for r in d.select(*by, "v", "n").collect()]
        for key, below in got.items():
            assert below == sum(r[-1] for r in all_rows if r[-2] < key[1] and (not by or r[0] == key[0]))
    assert with_sum_below(df.where("false"), "v", "n").count() == 0


def test_equal_series_have_equal_means_wherever_their_rows_lie(spark):
    """Means are added in order, so subjects with the same readings tie to the last bit; null readings are left out."""
    rng = np.random.default_rng(6)
    x = [None, *(40 + rng.exponential(50, 60).round(2)).tolist(), None]
    rows = [(f"U{k}", v, "full_day", "ab"[k % 2], 100 * i + k) for i, v in enumerate(x) for k in range(12)]
    rows = [rows[i] for i in rng.permutation(len(rows))] + [("none", None, "full_day", "a", 0)]
    df = spark.createDataFrame(rows, "id string, glucose double, metric_period string, group string, _ord long").repartition(7)
    m = M.base_metrics(df, keys=["id", "group", "metric_period"], order="_ord")
    total = 0.0
    for v in x[1:-1]:
        total += v
    assert {r["mean_glucose"] for r in m.where("id <> 'none'").collect()} == {total / 60} and m.where("id = 'none'").first()["mean_glucose"] is None
    got = {r["group"]: r.asDict() for r in T.rank_sums(m, "mean_glucose").collect()}
    assert all(r["tie_term"] == 12**3 - 12 and r["rank_sum"] == 6 * 6.5 and r["n"] == 6 for r in got.values())


def test_rank_queries_add_means_in_order(spark, tmp_path):
    """Of subjects whose rows lie in several files, those with the same readings tie in the queries, too."""
    rng = np.random.default_rng(7)
    x = rng.exponential(50, 60).round(2).tolist()
    rows = [(100 * i + k, 1767225600 + i, k, "view", v) for i, v in enumerate(x) for k in range(12)]
    e = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "event_id long, s long, user_id long, event_type string, value double")
    e.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["group"]: r.asDict() for r in QUERIES["rank_sums"](spark, str(tmp_path)).collect()}
    assert all(r["tie_term"] == 12**3 - 12 and r["rank_sum"] == 6 * 6.5 for r in got.values())


def test_predictive_exports_and_cards(spark):
    rng = np.random.default_rng(4)
    wave = lambda n, low: [130 + low * math.sin(4 * math.pi * i / 288) + rng.normal(0, 15) for i in range(n)]
    ex = R.examples(series(spark, wave(288 * 4, 70)).unionByName(series(spark, wave(30, 65), id="B"))).cache()
    scores, perf, importance = E.complete_predictive(ex)
    assert scores.columns == ["Subject ID", "Timestamp", "Date", "Split", "Current glucose", "Observed event", "Future glucose summary", "Risk probability", "Target", "Model", "Horizon"]
    assert scores.count() == ex.count() and scores.where("`Subject ID` = 'B' and `Risk probability` is not null").count() == 0
    row = one(perf)
    assert row["Subject ID"] == "A" and row["Model"] == "Logistic regression" and row["Horizon"] == "30 minutes" and 0.5 < row["AUC"] <= 1 and row["AUC"] == round(row["AUC"], 3)
    labels = {r["Model input"]: r["Feature"] for r in importance.collect()}
    assert set(labels) == set(R.feature_columns()) and labels["lag_15_glucose"] == "Glucose 15 min ago" and labels["window_30_sd"] == "Glucose variability over previous 30 min"
    bundle = R.risk_bundle(ex.where("id = 'A'"))
    cards = {r["Label"]: r["Value"] for r in bundle["cards"].collect()}
    assert list(cards) == ["Status", "Examples", "Test events", "AUC", "Brier"] and cards["Status"] == "Ready" and cards["Examples"] == f"{ex.where('id = \'A\'').count():,}"
    none = R.risk_bundle(ex.where("id = 'B'"))
    assert {r["Label"]: r["Value"] for r in none["cards"].collect()} | {"Examples": ""} == {"Status": "Needs more rows", "Examples": "", "Test events": "Not available", "AUC": "Not available", "Brier": "Not available"}
    assert none["message"] == "Needs at least 80 examples." and none["scores"].where("risk_probability is not null").count() == 0


@pytest.mark.parametrize("embedding, cell_rows, n", [(2, 2048, 5000), (2, 40, 900), (1, 60, 700), (3, 100, 800)])
def test_sample_entropy_of_whole_series_equals_all_pairs(spark, monkeypatch, embedding, cell_rows, n):
    """Also where most templates lie in few cells and these are cut into many blocks."""
    monkeypatch.setattr(C, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(n)
    a = np.round(120 + 30 * np.sin(np.arange(n) / 40) + rng.normal(0, 8, n))
    b = np.where(rng.random(300) < 0.8, 100.0, rng.uniform(60, 250, 300))  # one cell holds most
    params = ComplexityParams(thin_to=None, embedding=embedding, scales=3)
    got = {(r["id"], r["scale"]): r["sample_entropy"] for r in C.mse(series(spark, a).unionByName(series(spark, b, id="B")).unionByName(series(spark, [100.0] * 50, id="C")), params).collect()}
    want = {}
    for i, x in (("A", a), ("B", b)):
        for scale in (1, 2, 3):
            coarse = x[: len(x) // scale * scale].reshape(-1, scale).mean(axis=1)
            e = C.sample_entropy(coarse, embedding, params.tolerance * coarse.std(ddof=1))
            if math.isfinite(e):
                want[i, scale] = e
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("size", [32, 100, 2048])
def test_near_pairs_by_sets_of_bits_equal_all_pairs(monkeypatch, size):
    """Also where a difference is the tolerance but for rounding, where rows count more than once, and where both sides of a value cut."""
    monkeypatch.setattr(C, "FEW_PAIRS", 0)
    monkeypatch.setattr(C, "SET", size)
    rng = np.random.default_rng(size)
    draws = [lambda n: rng.normal(size=n), lambda n: rng.integers(0, 12, n).astype(float), lambda n: rng.integers(0, 30, n) / 10]
    for k in range(90):
        m, most, shift = int(rng.integers(1, 4)), (1, 7, 1000)[k % 3], k % 2
        a, b = (np.column_stack([draws[k % 3]((n, m + 1)), rng.integers(1, most + 1, n)]) for n in rng.integers(1, 400, 2))
        b[:, 0] += shift
        r = float(rng.choice([0.1, 0.3, 1, 2, 100]))
        near = np.all([np.abs(a[:, None, j] - b[:, j]) <= r for j in range(m)], axis=0)
        more = near & (np.abs(a[:, None, m] - b[:, m]) <= r)
        assert C.near_pairs(a, b, r) == (int(a[:, -1] @ near @ b[:, -1]), int(a[:, -1] @ more @ b[:, -1]))


def test_whole_series_are_cut_into_templates_block_by_block(spark, monkeypatch):
    """Readings are not repeated for each scale and place: a block of them gives its different templates; also where templates reach beyond a short block."""
    tables, stored = {}, C.stored

    def kept(df, name):
        tables[name] = stored(df, name)
        return tables[name]

    monkeypatch.setattr(C, "stored", kept)
    monkeypatch.setattr(C, "CELL_ROWS", 20)
    x = np.repeat(np.random.default_rng(5).integers(60, 250, 30).astype(float), 200)
    y = np.where(np.random.default_rng(8).random(1500) < 0.9, np.random.default_rng(9).uniform(99, 101, 1500), 200.0)  # most in one cell, more than is held at a time
    for v, block, params in ((x, 1024, ComplexityParams(thin_to=None, scales=2)), (x, 7, ComplexityParams(thin_to=None, scales=3)), (y, 50, ComplexityParams(thin_to=None, scales=3))):
        monkeypatch.setattr(C, "BLOCK", block)
        got = {r["scale"]: r["sample_entropy"] for r in C.mse(series(spark, v), params).collect()}
        for scale in range(1, params.scales + 1):
            coarse = v[: len(v) // scale * scale].reshape(-1, scale).mean(axis=1)
            assert got.pop(scale) == pytest.approx(C.sample_entropy(coarse, params.embedding, params.tolerance * coarse.std(ddof=1)), abs=1e-12)
        assert not got
        if block == 1024:
            assert tables["coarse"].count() <= 6 * 2 * 20  # of 6000 and 3000 places
            assert tables["templates"].agg(F.sum(F.size("xs"))).first()[0] <= 4 * 2 * 3 * 30 and tables["templates"].agg(F.max(F.size("xs"))).first()[0] <= 4 * 20


def test_lttb_of_long_series_is_one_pass(spark):
    """The points of one walk over the whole series, however many days and tasks it lies in; corners are all that is looked at."""
    rng = np.random.default_rng(9)
    y = np.round(120 + 40 * np.sin(np.arange(60_000) / 90) + rng.normal(0, 12, 60_000))
    y[5000:9000] = 100.0  # a flat stretch longer than a bucket
    got = D.lttb(series(spark, y).repartition(7), 100)
    want = set(D.lttb_indices(np.arange(60_000) * 300e6, y, 100).tolist()) | {int(y.argmin()), int(y.argmax())}
    first = series(spark, y[:1]).first()["timestamp"]
    assert {int((r["timestamp"] - first).total_seconds() // 300) for r in got.collect()} == want
    for n in (3, 5, 99, 100, 101, 102, 250):
        found = {int((r["timestamp"] - first).total_seconds() // 300) for r in D.lttb(series(spark, y[:n]), 100).collect()}
        assert found == set(D.lttb_indices(np.arange(n) * 300e6, y[:n], 100).tolist()) | {int(y[:n].argmin()), int(y[:n].argmax())}
    p = rng.integers(0, 30, (500, 2)).astype(float)
    p = p[np.argsort(p[:, 0], kind="stable")]
    corner = p[D.hull(p[:, 0], p[:, 1])]
    for angle in np.linspace(0, 6.28, 60):
        way = np.array([np.cos(angle), np.sin(angle)])
        assert (corner @ way).max() == (p @ way).max()


def test_forest_of_the_query_has_the_reference_s_trees(spark, monkeypatch):
    from glucolake.plans import queries

    seen = []
    monkeypatch.setattr(R, "fit_and_score", lambda ex, params: (seen.append(params.normalized().trees), (None, ""))[1])
    queries.QUERIES["predictive_importance"](spark, "/root/testdata/sf0.001")
    assert seen == [200]

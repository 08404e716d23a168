"""Functional daily profiles: gridding, penalised spline smoothing, subject curves, features, principal components, phenotypes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.config import FunctionalParams, Thresholds
from glucolake.functions.columns import finite, minute_of_day, real_subject
from glucolake.functions.tables import stored


def day_grid(df: DataFrame, params: FunctionalParams = FunctionalParams()) -> DataFrame:
    """Mean glucose by subject, day and slot (``time_minutes``; halves to even, midnight of the next day in the last slot)."""
    g = params.grid_minutes
    slot = F.bround(minute_of_day() / g) * g
    d = df.withColumn("x", finite("glucose")).where(real_subject() & F.col("timestamp").isNotNull() & F.col("x").isNotNull())
    imputed = F.coalesce(F.col("imputed_flag"), F.lit(False)) if "imputed_flag" in df.columns else F.lit(False)
    d = d.select("id", F.to_date("timestamp").alias("date"), F.when(slot >= 1440, 1440 - g).otherwise(slot).cast("int").alias("time_minutes"), "x", imputed.alias("imputed"))
    return d.groupBy("id", "date", "time_minutes").agg(F.avg("x").alias("raw_glucose"), F.count("*").alias("observed_points"), F.count_if("imputed").alias("imputed_points"))


@functools.lru_cache(maxsize=8)
def spline(grid_minutes: int, nbasis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cubic B-spline basis on the day's slots: values, first and second derivative, and the penalty on curvature."""
    knots = np.r_[[0.0] * 3, np.linspace(0, 1440, nbasis - 2), [1440.0] * 3]

    def basis(t: np.ndarray, degree: int) -> np.ndarray:
        b = ((knots[:-1] <= t[:, None]) & (t[:, None] < knots[1:])).astype(float)
        b[t >= 1440, np.flatnonzero(knots[:-1] < knots[1:])[-1]] = 1
        for k in range(1, degree + 1):
            n = len(knots) - 1 - k
            left, right = knots[k : k + n] - knots[:n], knots[k + 1 : k + 1 + n] - knots[1 : 1 + n]
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.where(left > 0, (t[:, None] - knots[:n]) / left, 0)
                c = np.where(right > 0, (knots[k + 1 : k + 1 + n] - t[:, None]) / right, 0)
            b = a * b[:, :n] + c * b[:, 1 : n + 1]
        return b

    def derived(t: np.ndarray, order: int) -> np.ndarray:
        b = basis(t, 3 - order)
        for k in range(3 - order + 1, 4):
            n = len(knots) - 1 - k
            left, right = knots[k : k + n] - knots[:n], knots[k + 1 : k + 1 + n] - knots[1 : 1 + n]
            b = k * (b[:, :n] * np.where(left > 0, 1 / np.where(left > 0, left, 1), 0) - b[:, 1 : n + 1] * np.where(right > 0, 1 / np.where(right > 0, right, 1), 0))
        return b

    t = np.arange(0, 1440, grid_minutes, dtype=float)
    edges = np.unique(knots)
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    points = np.r_[mid - half / np.sqrt(3), mid + half / np.sqrt(3)]  # exact for the squared second derivative
    curve = derived(points, 2)
    return basis(t, 3), derived(t, 1), derived(t, 2), curve.T @ (np.r_[half, half][:, None] * curve)


@functools.lru_cache(maxsize=8)
def fourier(grid_minutes: int, nbasis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for sines and cosines of the day: an odd number of functions, each of norm one over the day."""
    pairs = max(1, (nbasis - 1) // 2)
    t, w = np.arange(0, 1440, grid_minutes, dtype=float)[:, None], 2 * np.pi * np.arange(1, pairs + 1) / 1440
    size = np.sqrt(2 / 1440)

    def interleaved(first: np.ndarray, second: np.ndarray, constant: float) -> np.ndarray:
        return np.column_stack([np.full(len(t), constant), np.stack([first, second], axis=2).reshape(len(t), -1) * size])

    sine, cosine = np.sin(t * w), np.cos(t * w)
    penalty = np.diag(np.r_[0.0, np.repeat(w**4, 2)])
    return interleaved(sine, cosine, 1440**-0.5), interleaved(w * cosine, -w * sine, 0.0), interleaved(-(w**2) * sine, -(w**2) * cosine, 0.0), penalty


def smooth(time: np.ndarray, value: np.ndarray, params: FunctionalParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, rate per hour and acceleration per hour squared on the whole grid, in the basis that ``params`` names."""
    functions = fourier if params.basis == "fourier" else spline
    b, d1, d2, penalty = functions(params.grid_minutes, min(params.nbasis, max(4, len(time))))
    at = b[(time // params.grid_minutes).astype(int)]
    c = np.linalg.lstsq(at.T @ at + params.smoothing * penalty, at.T @ value, rcond=None)[0]
    return b @ c, d1 @ c * 60, d2 @ c * 3600


@functools.lru_cache(maxsize=64)
def _roughness(slots: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """For one set of filled slots: the banded matrices of a natural cubic spline through them, and the eigenvalues and vectors of its curvature, from which the fit for every penalty follows."""
    t = np.array(slots, float)
    h = np.diff(t)
    n = len(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    return t, q, r, np.maximum(values, 0), vectors


def smoothing_spline(time: np.ndarray, value: np.ndarray, params: FunctionalParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by a natural cubic spline with a knot at every filled slot, its penalty chosen by generalised cross-validation; straight beyond the outer slots."""
    t, q, r, values, vectors = _roughness(tuple(int(x) // params.grid_minutes for x in time))
    seen = vectors.T @ value
    scale = max(values[-1], 1e-12)
    # From hardly any to an almost straight line, in even steps of the logarithm.
    best = None
    for penalty in np.logspace(-6, 9, 91) / scale:
        kept = 1 / (1 + penalty * values)
        spare = len(value) - kept.sum()
        if spare > 1e-6 * len(value):
            gcv = len(value) * float(((1 - kept) * seen) @ ((1 - kept) * seen)) / spare**2
            if best is None or gcv < best[0]:
                best = gcv, kept
    fitted = vectors @ (best[1] * seen) if best else value
    curve = np.r_[0.0, np.linalg.solve(r, q.T @ fitted), 0.0]
    at = np.arange(1440 // params.grid_minutes, dtype=float)
    j = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = t[j + 1] - t[j]
    x = np.clip(at, t[0], t[-1])
    u, v = x - t[j], t[j + 1] - x
    y = (u * fitted[j + 1] + v * fitted[j]) / h - u * v / 6 * ((1 + u / h) * curve[j + 1] + (1 + v / h) * curve[j])
    slope = (fitted[j + 1] - fitted[j]) / h + (curve[j + 1] * (3 * u**2 - h**2) - curve[j] * (3 * v**2 - h**2)) / (6 * h)
    bend = (u * curve[j + 1] + v * curve[j]) / h
    outside = at != x
    step = params.grid_minutes
    return np.where(outside, y + slope * (at - x), y), slope / step * 60, np.where(outside, 0.0, bend) / step**2 * 3600


def day_curves(df: DataFrame, params: FunctionalParams = FunctionalParams()) -> DataFrame:
    """Smoothed days: a row per slot.  Days with too few filled slots are left out; a day with a value outside [low, high] is ``invalid`` and has nulls.

    Where the basis can't be fitted, a smoothing spline takes its place (``fallback``, with a note).
    """
    grid = day_grid(df, params)
    enough = grid.groupBy("id", "date").agg(F.count("*").alias("slots"), F.sum("observed_points").alias("op"), F.sum("imputed_points").alias("ip")).where(F.col("slots") >= params.min_slots).drop("slots")
    step = params.grid_minutes

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time_minutes")
        time, raw_values, note, state = pdf["time_minutes"].to_numpy(), pdf["raw_glucose"].to_numpy(), "", "ok"
        try:
            y, rate, acceleration = (smoothing_spline if params.basis == "smoothing_spline" else smooth)(time, raw_values, params)
            if not np.isfinite(y).all():
                raise np.linalg.LinAlgError("the fit is not finite")
        except np.linalg.LinAlgError as error:
            y, rate, acceleration = smoothing_spline(time, raw_values, params)
            note, state = f"Basis smoothing failed; used a smoothing spline. Details: {error}", "fallback"
        bad = bool((y < params.low).any() or (y > params.high).any() or not np.isfinite(y).all())
        out = pd.DataFrame({"id": key[0], "date": key[1], "time_minutes": np.arange(0, 1440, step, dtype=np.int32)})
        raw = pd.Series(pdf["raw_glucose"].to_numpy(), index=pdf["time_minutes"])
        out["raw_glucose"] = raw.reindex(out["time_minutes"]).to_numpy()
        out["smoothed_glucose"], out["rate"], out["acceleration"] = (np.full(len(y), np.nan) if bad else v for v in (y, rate, acceleration))
        out["observed_points"], out["imputed_points"] = int(pdf["op"].iloc[0]), int(pdf["ip"].iloc[0])
        out["smoothing_status"] = "invalid" if bad else state
        out["smoothing_note"] = note
        return out

    curves = grid.join(enough, ["id", "date"]).groupBy("id", "date").applyInPandas(
        fit, "id string, date date, time_minutes int, raw_glucose double, smoothed_glucose double, rate double, acceleration double, observed_points long, imputed_points long, smoothing_status string, smoothing_note string"
    )
    return curves.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("raw_glucose", "smoothed_glucose", "rate", "acceleration")})


def subject_curves(days: DataFrame, value: str = "smoothed_glucose", rate: str | None = "rate") -> DataFrame:
    """Mean, quartiles and mean rate by subject and slot over valid days."""
    extra = [F.avg(rate).alias("mean_rate")] if rate else []
    return days.where(F.col(value).isNotNull()).groupBy("id", "time_minutes").agg(
        F.avg(value).alias("mean_glucose"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"), *extra, F.count_distinct("date").alias("days"),
    )


def curve_features(curves: DataFrame, thresholds: Thresholds = Thresholds(), grid_minutes: int = 5) -> DataFrame:
    """Features of subject curves: peak and nadir (the first on ties), time and area by range, overnight slope, morning rise, steepest rise and fall."""
    g, t, h = F.col("mean_glucose"), F.col("time_minutes"), grid_minutes / 60
    first = lambda by, what: F.min_by(what, F.struct(by, t))
    area = lambda c: F.sum(F.greatest(F.lit(0.0), c)) * h
    n = F.count(g)
    rates = [F.max("mean_rate").alias("max_rise_rate"), F.min("mean_rate").alias("max_fall_rate")] if "mean_rate" in curves.columns else []
    return curves.groupBy("id").agg(
        F.max("days").alias("days"), first(-g, t).alias("peak_minutes"), F.max(g).alias("peak_glucose"), first(g, t).alias("nadir_minutes"), F.min(g).alias("nadir_glucose"),
        (100 * F.count_if(g < thresholds.tir_lower) / n).alias("time_below_range_percent"), (100 * F.count_if(g.between(thresholds.tir_lower, thresholds.tir_upper)) / n).alias("time_in_range_percent"),
        (100 * F.count_if(g > thresholds.tir_upper) / n).alias("time_above_range_percent"), area(g - thresholds.tir_upper).alias("area_above"), area(thresholds.tir_lower - g).alias("area_below"), *rates,
        F.when(F.count_if(t < 360) >= 2, F.regr_slope(F.when(t < 360, g), F.when(t < 360, t / 60))).alias("overnight_slope"),
        (F.avg(F.when((t >= 360) & (t < 600), g)) - F.avg(F.when((t >= 240) & (t < 360), g))).alias("morning_rise"),
    )


def minutes_label(c: str):
    return F.format_string("%02d:%02d", F.floor(F.col(c) / 60).cast("int"), (F.col(c) % 60).cast("int"))


def features(days: DataFrame, curves: DataFrame, thresholds: Thresholds = Thresholds(), grid_minutes: int = 5) -> DataFrame:
    """Curve features with day counts and readings behind them."""
    per_day = days.groupBy("id", "date").agg(F.max("observed_points").alias("op"), F.max("imputed_points").alias("ip"), F.bool_and(F.col("smoothing_status") != "invalid").alias("ok"))
    counts = per_day.groupBy("id").agg(F.count_if("ok").alias("valid_fda_days"), F.count_if(~F.col("ok")).alias("excluded_fda_days"), F.sum("op").alias("observed_points"), F.sum("ip").alias("imputed_points"))
    f = curve_features(curves, thresholds, grid_minutes)
    f = f.withColumns({"peak_time": minutes_label("peak_minutes"), "nadir_time": minutes_label("nadir_minutes"), "glucose_amplitude": F.col("peak_glucose") - F.col("nadir_glucose")})
    return f.join(counts, "id", "left").withColumn("profile_basis", F.when(F.col("imputed_points") > 0, "Observed and imputed").otherwise("Observed"))


# The headings of the feature table, in its order, and those of its short form.
FEATURE_LABELS = {
    "id": "Subject ID", "days": "Days", "valid_fda_days": "Valid FDA days", "excluded_fda_days": "Excluded FDA days",
    "observed_points": "Observed readings", "imputed_points": "Imputed readings", "profile_basis": "Profile basis",
    "peak_time": "Peak time", "peak_glucose": "Peak glucose", "nadir_time": "Nadir time", "nadir_glucose": "Nadir glucose",
    "time_below_range_percent": "Time below range (%)", "time_in_range_percent": "Time in range (%)", "time_above_range_percent": "Time above range (%)",
    "area_below": "Area below range (mg/dL-hour)", "area_above": "Area above range (mg/dL-hour)",
    "max_rise_rate": "Max rise rate (mg/dL/hour)", "max_fall_rate": "Max fall rate (mg/dL/hour)",
    "overnight_slope": "Overnight slope (mg/dL/hour)", "morning_rise": "Morning rise (mg/dL)",
    "fpca1": "FPCA 1", "fpca2": "FPCA 2", "phenotype_group": "Phenotype group",
}
LONG_FORM_ONLY = ("imputed_points", "area_below", "area_above", "fpca1", "fpca2")


def features_display(features: DataFrame, groups: DataFrame | None = None, show_id: bool = True) -> DataFrame:
    """The feature table with its headings; ``groups`` (``id``, ``group``, one row a subject) adds the group, null where a subject has none."""
    d = features
    if groups is not None:
        d = d.join(groups.select(F.col("id").alias("of"), F.col("group").cast("string").alias("Group")), F.col("id") == F.col("of"), "left").drop("of")
    d = d.withColumnsRenamed({c: label for c, label in FEATURE_LABELS.items() if c in d.columns})
    return d if show_id else d.drop(FEATURE_LABELS["id"])


def key_features(features: DataFrame, groups: DataFrame | None = None, show_id: bool = True) -> DataFrame:
    """The short form: counts of days and readings whole, other numbers to two places (half even)."""
    d = features_display(features, groups, show_id)
    numeric = {c for c, kind in d.dtypes if kind in ("double", "float", "int", "bigint")}
    labels = [label for c, label in FEATURE_LABELS.items() if c not in LONG_FORM_ONLY]
    labels.insert(1, "Group")
    places = lambda c: 0 if re.search("readings|days", c, re.I) else 2
    return d.select(*(F.bround(F.col(f"`{c}`"), places(c)).alias(c) if c in numeric else F.col(f"`{c}`") for c in labels if c in d.columns))


def smoothing_warning(days: DataFrame, params: FunctionalParams = FunctionalParams()) -> DataFrame:
    """One row, ``warning``: how many days smoothing made implausible, empty where none."""
    per_day = days.groupBy("id", "date").agg(F.bool_or(F.col("smoothing_status") == "invalid").alias("bad"))
    n = per_day.agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))
    count = lambda c: F.format_number(F.col(c), 0)
    text = F.concat(count("bad"), F.lit(" of "), count("n"), F.lit(f" FDA day profile(s) were excluded after smoothing produced implausible values outside {params.low:g}-{params.high:g} mg/dL."))
    return n.select(F.when(F.col("bad") > 0, text).otherwise("").alias("warning"))


def curve_rows(curves: DataFrame, grid_minutes: int = 5) -> DataFrame:
    """``id`` and ``y``: a subject's curve over all slots, NaN where it has none."""
    held = curves.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("time_minutes"), F.col("mean_glucose")))).alias("held"))  # a day's slots
    slots = F.sequence(F.lit(0), F.lit(1440 - grid_minutes), F.lit(grid_minutes))
    return held.select("id", F.transform(slots, lambda t: F.coalesce(F.try_element_at("held", t), F.lit(float("nan")))).alias("y"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def mean_and_covariance(rows: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Of curves as they are: the mean of each slot, and the covariance of each two slots over the curves that have both (NaN where fewer than two have).

    Tasks add up their own curves' sums; what is added up between tasks is a row for each slot.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, slots, slots))
        for batch in batches:
            y = _matrix(batch)
            has = np.isfinite(y)
            x, h = np.where(has, y - 150.0, 0.0), has.astype(float)  # near the middle of the scale, so little is lost to rounding
            held += np.stack([h.T @ h, x.T @ h, h.T @ x, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots), pa.int32()), pa.array([np.ascontiguousarray(held[:, i]).tobytes() for i in range(slots)], pa.binary())], ["slot", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table({"slot": table.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(sums, "slot int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary").collect()
    n, one, other, both = np.stack([np.frombuffer(r["sums"]).reshape(4, slots) for r in sorted(found)], axis=1) if found else np.zeros((4, slots, slots))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = 150.0 + np.diag(one) / np.diag(n)
        m = mean - 150.0
        covariance = np.where(n >= 2, (both - m[:, None] * other - m * one + n * np.outer(m, m)) / (n - 1), np.nan)
    return mean, covariance


def filled(covariance: np.ndarray) -> np.ndarray:
    """Pairs of slots that no two curves have get the mean of the pairs around, as near as there are any; the day is round."""
    out, size = covariance.copy(), 1
    while np.isnan(out).any() and size <= len(out) // 2:
        shifts = [(i, j) for i in range(-size, size + 1) for j in range(-size, size + 1) if max(abs(i), abs(j)) == size]
        around = np.stack([np.roll(covariance, s, (0, 1)) for s in shifts])
        n = np.isfinite(around).sum(axis=0)
        near = np.nansum(around, axis=0) / np.maximum(n, 1)
        out = np.where(np.isnan(out) & (n > 0), near, out)
        size += 1
    return np.nan_to_num((out + out.T) / 2)


def fpca_scores(curves: DataFrame, params: FunctionalParams = FunctionalParams()) -> DataFrame:
    """Scores on the first two principal components of subject curves; each component's largest loading is positive.  Fewer than two subjects: nulls.

    Mean and covariance come from curves as they are, slots missing or not; a subject's scores are
    their expectation given the slots it has, which for whole curves are the projections.
    """
    slots = 1440 // params.grid_minutes
    rows = stored(curve_rows(curves, params.grid_minutes), "curves")
    if rows.limit(2).count() < 2:
        return rows.select("id", F.lit(None).cast("double").alias("fpca1"), F.lit(None).cast("double").alias("fpca2"))
    mean, covariance = mean_and_covariance(rows, slots)
    values, vectors = np.linalg.eigh(filled(covariance))
    values = np.maximum(values, 0)
    whole = (vectors * values) @ vectors.T
    load = vectors[:, ::-1][:, :2] * np.where(np.take_along_axis(vectors[:, ::-1][:, :2], np.abs(vectors[:, ::-1][:, :2]).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    size = values[::-1][:2]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch)
            out = np.zeros((len(y), 2))
            for k, row in enumerate(y):
                has = np.isfinite(row) & np.isfinite(mean)
                d = (row - mean)[has]
                out[k] = load.T @ d if has.all() else (size * load[has]).T @ (np.linalg.pinv(whole[np.ix_(has, has)], rcond=1e-9, hermitian=True) @ d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], ["id", "fpca1", "fpca2"])

    return rows.mapInArrow(expect, "id string, fpca1 double, fpca2 double")


def phenotypes(scores: DataFrame, params: FunctionalParams = FunctionalParams()) -> DataFrame:
    """Groups of subjects by k-means on their scores, numbered by the first coordinate of their centre; with too few subjects all are ``Phenotype 1``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    known = scores.where("fpca1 is not null").fillna({"fpca2": 0.0})
    n, distinct = known.agg(F.count("*"), F.count_distinct("fpca1", "fpca2")).first()
    k = min(params.clusters, distinct, n - 1)
    if k < 2:
        return scores.withColumn("phenotype_group", F.lit("Phenotype 1"))
    x = VectorAssembler(inputCols=["fpca1", "fpca2"], outputCol="x").transform(known)
    model = KMeans(k=k, seed=1, featuresCol="x", predictionCol="c").fit(x)
    rank = {c: i + 1 for i, c in enumerate(sorted(range(len(model.clusterCenters())), key=lambda c: tuple(model.clusterCenters()[c])))}
    label = F.create_map(*(F.lit(y) for c, i in rank.items() for y in (c, f"Phenotype {i}")))
    found = model.transform(x).select("id", label[F.col("c")].alias("phenotype_group"))
    return scores.join(found, "id", "left").withColumn("phenotype_group", F.coalesce("phenotype_group", F.lit("Phenotype 1")))


def profile_bundle(df: DataFrame, params: FunctionalParams = FunctionalParams(), thresholds: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Day curves, subject curves with their phenotype, features and scores."""
    days = day_curves(df, params)
    curves = subject_curves(days)
    groups = phenotypes(fpca_scores(curves, params), params)
    return {
        "day_curves": days, "subject_curves": curves.join(groups.select("id", "phenotype_group"), "id", "left"),
        "features": features(days, curves, thresholds, params.grid_minutes).join(groups, "id", "left"), "scores": groups,
    }

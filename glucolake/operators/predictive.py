"""Retrospective risk of low or high glucose: lagged and windowed features, labels, split, models, performance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import PredictiveParams, Thresholds
from glucolake.functions.columns import MICROS_PER_MINUTE, finite, micros, minute_of_day, real_subject, with_sum_below
from glucolake.functions.tables import stored
from glucolake.operators.forest import Forests

DAY = 1440 * MICROS_PER_MINUTE


def feature_columns(params: PredictiveParams = PredictiveParams()) -> list[str]:
    return ["glucose_current", *(f"lag_{k}_glucose" for k in params.lag_minutes), *(f"window_{w}_{m}" for w in params.window_minutes for m in ("mean", "sd", "min", "max", "slope")), "time_sin", "time_cos"]


def target_label(params: PredictiveParams, thresholds: Thresholds = Thresholds()) -> str:
    side = f"above {thresholds.tir_upper:g}" if params.target == "high" else f"below {thresholds.tir_lower:g}"
    return f"Glucose {side} mg/dL within {params.horizon_minutes} minutes"


def in_chunks(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Rows by subject and day (``chunk``), each day with what its windows need of its neighbours (``own`` false): the rows of the last ``before`` microseconds of the day before, of the first ``after`` of the next, and the last row further back.

    So windows run over a subject's day, not over all its rows.
    """
    d = rows.withColumn("day", F.floor(F.col("us") / DAY))
    tod = F.col("us") - F.col("day") * DAY
    near = d.withColumn("to", F.explode(F.filter(F.array(F.struct(F.col("day").alias("chunk"), F.lit(True).alias("own")), F.when(tod >= DAY - before, F.struct((F.col("day") + 1).alias("chunk"), F.lit(False).alias("own"))), F.when(tod < after, F.struct((F.col("day") - 1).alias("chunk"), F.lit(False).alias("own")))), lambda x: x.isNotNull())))
    near = near.select("id", "us", "glucose", "_ord", "to.chunk", "to.own")
    # The last row before the part that was taken whole: of the day before its last early row, else an earlier day's last.
    row = F.struct("us", "_ord", "glucose")
    days = d.groupBy("id", "day").agg(F.max(F.when(tod < DAY - before, row)).alias("early"), F.max(row).alias("last"))
    back = Window.partitionBy("id").orderBy("day")
    prev, last1, last2 = F.lag("day").over(back), F.lag("last").over(back), F.lag("last", 2).over(back)
    far = days.select("id", F.col("day").alias("chunk"), F.when(prev == F.col("day") - 1, F.coalesce(F.lag("early").over(back), last2)).otherwise(last1).alias("far")).where("far is not null")
    far = far.select("id", "far.us", "far.glucose", "far._ord", "chunk", F.lit(False).alias("own"))
    return near.unionByName(far)


def cell_sums(cell: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row count, sum, squared deviations, least and most of the rows of its cell up to and with it; rows of a cell lie together.

    Spans double in each round and meet by their means, so no large sums are subtracted.
    """
    first = np.r_[True, cell[1:] != cell[:-1]]
    at = np.arange(len(g))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    total, dev, low, high = g.copy(), np.zeros(len(g)), g.copy(), g.copy()
    step, most = 1, place.max(initial=0)
    while step <= most:
        both, before = place[step:] >= step, np.minimum(place[:-step] + 1, step)
        a, b = slice(step, None), slice(None, -step)
        apart = total[a] / step - total[b] / before
        dev[a] += np.where(both, dev[b] + apart * apart * (before * step / (before + step)), 0.0)
        total[a] += np.where(both, total[b], 0.0)
        low[a] = np.where(both, np.minimum(low[a], low[b]), low[a])
        high[a] = np.where(both, np.maximum(high[a], high[b]), high[a])
        step *= 2
    return place + 1, total, dev, low, high


def span_sums(group: np.ndarray, at: np.ndarray, g: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, mean, squared deviations, least and most of the rows ``lo`` to ``hi`` of each span, which is no longer than ``width`` and doesn't leave its group.

    Time is cut into cells of that width: a span that starts in one cell and ends in the next is the end of
    the first and the start of the second, so a row costs the same however many there are in a span.
    A span that lies in one cell must reach to one of its ends.
    """
    cell = np.floor_divide(at, width)
    new = np.r_[True, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])]
    cell = np.cumsum(new)
    start = cell_sums(cell, g)
    end = tuple(v[::-1] for v in cell_sums(cell[::-1], g[::-1]))
    some = hi >= lo
    lo, hi = np.where(some, lo, 0), np.where(some, hi, 0)
    two, from_start = cell[lo] != cell[hi], (lo == 0) | new[lo]
    # What ends at ``hi`` counts unless the span stops short of its cell's start; what starts at ``lo`` if it is in another cell or does.
    use_a, use_b = some & (two | ~from_start), some & (two | from_start)
    na, nb = np.where(use_a, end[0][lo], 0), np.where(use_b, start[0][hi], 0)
    sa, sb = np.where(use_a, end[1][lo], 0.0), np.where(use_b, start[1][hi], 0.0)
    n = na + nb
    apart = np.where(use_a & use_b, sa / np.maximum(na, 1) - sb / np.maximum(nb, 1), 0.0)
    dev = np.where(use_a, end[2][lo], 0.0) + np.where(use_b, start[2][hi], 0.0) + apart * apart * (na * nb / np.maximum(n, 1))
    low = np.minimum(np.where(use_a, end[3][lo], np.inf), np.where(use_b, start[3][hi], np.inf))
    high = np.maximum(np.where(use_a, end[4][lo], -np.inf), np.where(use_b, start[4][hi], -np.inf))
    return n, (sa + sb) / np.maximum(n, 1), dev, low, high


def chunk_windows(chunk: np.ndarray, us: np.ndarray, g: np.ndarray, own: np.ndarray, params: PredictiveParams, subject: np.ndarray) -> dict[str, np.ndarray]:
    """Lags, windows and what follows of the own rows of whole chunks, rows in order of time within a chunk; NaN where there is no value.  ``chunk`` is the day of each row, ``subject`` a number of its subject."""
    m = MICROS_PER_MINUTE
    group = np.cumsum(np.r_[True, (chunk[1:] != chunk[:-1]) | (subject[1:] != subject[:-1])])
    # Places within the day; the far row moves up to just before what windows can reach.
    reach = max(*params.lag_minutes, *params.window_minutes) * m
    at = np.maximum(us - chunk * DAY, -reach - 1)
    room = 2 * (DAY + reach + params.horizon_minutes * m)
    key = group * room + at
    row = np.flatnonzero(own)
    now, value, mine = key[row], g[row], group[row]
    out = {"glucose_current": value}
    for k in params.lag_minutes:
        i0, i1 = np.searchsorted(key, now - k * m, "right") - 1, np.searchsorted(key, now - k * m, "left")
        found = (i0 >= 0) & (group[np.maximum(i0, 0)] == mine)
        i0 = np.where(found, i0, 0)
        t0, g0, t1, g1 = us[i0], g[i0], us[i1], g[i1]
        lag = g0 + (g1 - g0) * ((us[row] - k * m - t0) / np.where(t1 != t0, t1 - t0, 1))
        out[f"lag_{k}_glucose"] = np.where(found, np.where(t1 == t0, g0, lag), np.nan)
    last = np.searchsorted(key, now, "right") - 1
    for w in params.window_minutes:
        lo = np.searchsorted(key, now - w * m, "right")
        n, mean, dev, low, high = span_sums(group, at, g, w * m, lo, last)
        hours = (us[row] - us[lo]) / (60 * m)
        slope = np.where(hours > 0, (value - g[lo]) / np.where(hours > 0, hours, 1), np.nan)
        out |= {f"window_{w}_{name}": v for name, v in (("mean", mean), ("sd", np.sqrt(dev / np.maximum(n - 1, 1))), ("min", low), ("max", high), ("slope", slope))}
    h = params.horizon_minutes * m
    n, _, _, low, high = span_sums(group, at, g, h, last + 1, np.searchsorted(key, now + h, "right") - 1)
    return out | {"future_points": n, "target_value": np.where(n > 0, high if params.target == "high" else low, np.nan)}


#: Rows of whole chunks that are worked on at a time, where a chunk has fewer.
WINDOW_ROWS = 50_000


def with_windows(chunks: DataFrame, params: PredictiveParams) -> DataFrame:
    """The own rows of ``in_chunks`` with their lags, windows, points and value to predict.

    A task has its chunks in order and works on whole ones, so what it holds is a subject's day at most, or ``WINDOW_ROWS`` rows of several.
    """
    numbers = ["glucose_current", *(f"lag_{k}_glucose" for k in params.lag_minutes), *(f"window_{w}_{s}" for w in params.window_minutes for s in ("mean", "sd", "min", "max", "slope"))]
    names = ["id", "us", *numbers, "future_points", "target_value"]

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        own = t.column("own").to_numpy()
        ids = t.column("id").combine_chunks()
        # Two subjects' chunks of the same day may follow each other: a change of subject is told apart by the codes of ids.
        code = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
        got = chunk_windows(t.column("chunk").to_numpy(), t.column("us").to_numpy(), t.column("glucose").to_numpy(), own, params, code)
        row = pa.array(np.flatnonzero(own))
        return pa.RecordBatch.from_arrays([ids.take(row), t.column("us").combine_chunks().take(row), *(pa.array(got[n], pa.float64()) for n in numbers), pa.array(got["future_points"], pa.int64()), pa.array(got["target_value"], mask=np.isnan(got["target_value"]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows + batch.num_rows >= WINDOW_ROWS:
                # Up to the last chunk that begins in this batch; it may go on in the next.
                day, who = batch.column("chunk").to_numpy(), batch.column("id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change = np.flatnonzero((day[1:] != day[:-1]) | (who[1:] != who[:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0
                if not cut and held and (held[-1].column("id")[-1], held[-1].column("chunk")[-1]) != (batch.column("id")[0], batch.column("chunk")[0]):
                    yield done(held)
                    held, rows = [], 0
                elif cut:
                    yield done([*held, batch.slice(0, cut)])
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield done(held)

    kinds = ", ".join(f"{n} double" for n in numbers)
    dealt = chunks.repartition("id", "chunk").sortWithinPartitions("id", "chunk", "us", "_ord").select("id", "chunk", "us", "glucose", "own")
    return dealt.mapInArrow(run, f"id string, us long, {kinds}, future_points long, target_value double")


def examples(df: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per reading with all features and a label: whether a later reading within the horizon is low (or high).

    Lags are interpolated between neighbours, null before the first reading; windows are (t - w, t];
    the last horizon of a subject and rows with a null feature are left out, as are subjects of fewer than three readings.
    """
    p = params.normalized()
    m = lambda minutes: minutes * MICROS_PER_MINUTE
    rows = df.withColumn("glucose", finite("glucose")).where(real_subject() & F.col("timestamp").isNotNull() & F.col("glucose").isNotNull()).select("id", micros().alias("us"), "glucose", "_ord")
    # The far row is always the earliest of its chunk and outside every window.
    reach = max(*p.lag_minutes, *p.window_minutes)
    c = with_windows(in_chunks(rows, m(reach), m(p.horizon_minutes) + 1), p)
    ends = rows.groupBy(F.col("id").alias("eid")).agg(F.max("us").alias("end"), F.count("*").alias("n")).where("n >= 3")
    c = c.join(ends, F.col("id") == F.col("eid")).where((F.col("us") <= F.col("end") - m(p.horizon_minutes)) & F.col("target_value").isNotNull())
    ts = F.timestamp_micros("us")
    angle = 2 * math.pi * minute_of_day(ts) / 1440
    c = c.withColumns({"timestamp": ts, "date": F.to_date(ts), "time_sin": F.sin(angle), "time_cos": F.cos(angle), "target": (F.col("target_value") > thresholds.tir_upper if p.target == "high" else F.col("target_value") < thresholds.tir_lower).cast("int"), "target_label": F.lit(target_label(p, thresholds))})
    return c.na.drop(subset=feature_columns(p)).select("id", "timestamp", "date", *feature_columns(p), "future_points", "target_value", "target", "target_label")


def split(ex: DataFrame, share: float = 0.3) -> DataFrame:
    """``ex`` with ``split``: with two subjects or more the test set is ``share`` of them (rounded up), those of the least hashes, else as many of the last days, else the last rows (rounded down); one at least."""
    subjects = ex.select("id").distinct().withColumns({"hash": F.xxhash64("id", F.lit(1)), "one": F.lit(1)})
    n = subjects.count()
    if n >= 2:
        test = with_sum_below(subjects, "hash", "one").where(F.col("below") < max(1, math.ceil(n * share))).select(F.col("id").alias("__id"))
        return ex.join(test, F.col("id") == F.col("__id"), "left").withColumn("split", F.when(F.col("__id").isNotNull(), "test").otherwise("train")).drop("__id")
    return training_rows(ex, share).drop("total")


def fit_status(total: int, events: int, others: int, params: PredictiveParams = PredictiveParams()) -> tuple[str, str]:
    """Whether ``total`` examples, with so many training rows with and without an event, are enough: a status and what to tell."""
    if total < params.min_examples:
        return "insufficient_examples", f"Needs at least {params.min_examples} examples."
    if not events + others:
        return "insufficient_features", "No complete predictive feature rows are available."
    if min(events, others) < params.min_events:
        return "insufficient_events", f"Training data needs at least {params.min_events} events and non-events."
    return "ready", "Predictive model trained for retrospective risk scoring."


def example_counts(ex: DataFrame) -> tuple[int, int, int]:
    """All examples of a table with ``split``, its training rows with an event and those without."""
    train = F.col("split") == "train"
    return tuple(ex.agg(F.count("*"), F.count_if(train & (F.col("target") == 1)), F.count_if(train & (F.col("target") == 0))).first())


def fit_and_score(ex: DataFrame, params: PredictiveParams = PredictiveParams()):
    """Scores (``risk_probability``) for all examples, with importances by feature; None and a reason where there is too little to learn from."""
    s = split(stored(ex, "examples"))
    status, message = fit_status(*example_counts(s), params.normalized())
    return (fitted_scores(s, params), "") if status == "ready" else (None, message)


def fitted_scores(s: DataFrame, params: PredictiveParams = PredictiveParams()) -> tuple[DataFrame, DataFrame]:
    """Scores and importances of a model fitted to the training rows of a table with ``split``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p = params.normalized()
    names = feature_columns(p)
    x = VectorAssembler(inputCols=names, outputCol="x").transform(s)
    model = RandomForestClassifier(numTrees=p.trees, seed=1, featuresCol="x", labelCol="target") if p.model == "random_forest" else LogisticRegression(regParam=0.0, featuresCol="x", labelCol="target")
    fitted = model.fit(x.where("split = 'train'"))
    weights = fitted.featureImportances.toArray() if p.model == "random_forest" else abs(fitted.coefficients.toArray())
    scores = fitted.transform(x).withColumn("risk_probability", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    importance = s.sparkSession.createDataFrame(sorted(((f, float(w)) for f, w in zip(names, weights, strict=True)), key=lambda r: -r[1]), "feature string, importance double")
    return scores, importance


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression by iteratively reweighted least squares; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(ex: DataFrame, share: float = 0.3) -> DataFrame:
    """``ex`` with ``total``, a subject's examples, and ``split``: of each subject by itself, ``share`` of its days, the last ones (rounded up), are the test set; of a subject of one day the last rows (rounded down); one at least."""
    by = Window.partitionBy("id")  # a row per day
    days = ex.groupBy("id", "date").agg(F.count("*").alias("n"))
    days = days.select(F.col("id").alias("__id"), F.col("date").alias("__date"), F.count("*").over(by).alias("__days"), F.row_number().over(by.orderBy(F.desc("date"))).alias("__back"), F.sum("n").over(by).alias("total"))
    rows = ex.join(days, (F.col("id") == F.col("__id")) & (F.col("date") == F.col("__date")))
    late = F.row_number().over(Window.partitionBy("id", "date").orderBy(F.desc("timestamp")))
    test = F.when(F.col("__days") > 1, F.col("__back") <= F.greatest(F.lit(1), F.ceil(F.col("__days") * F.lit(share)))).otherwise(late <= F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(share))))
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).drop("__id", "__date", "__days", "__back")


def large_subject_weights(rows: DataFrame, params: PredictiveParams, ridge: float = 1e-6) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean, deviation and weights of each subject, fitted on all its training rows: ``fit_weights`` with every step's sums added up by Spark.

    What comes to the driver is a row of sums for each subject and step.
    """
    import pandas as pd

    p, names = params.normalized(), feature_columns(params)
    train = rows.where("split = 'train'")
    moments = train.groupBy("id").agg(F.count("*").alias("n"), F.first("total").alias("total"), F.sum("target").alias("events"), F.array(*map(F.avg, names)).alias("mean"), F.array(*map(F.stddev_pop, names)).alias("sd")).collect()
    scale = {r["id"]: (np.array(r["mean"]), np.array([x if x > 0 else 1 for x in r["sd"]])) for r in moments if fit_status(r["total"], r["events"], r["n"] - r["events"], p)[0] == "ready"}
    width = len(names) + 1
    weights = {i: np.zeros(width) for i in scale}
    left = set(scale)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "sums": [sum(np.frombuffer(b) for b in pdf["sums"]).tobytes()]}, dtype=object)

    for _ in range(50):
        if not left:
            break
        now = {i: (*scale[i], weights[i]) for i in left}

        def sums(batches, now=now):
            held: dict[str, np.ndarray] = {}
            for pdf in batches:
                for i, part in pdf.groupby("id"):
                    if i in now:
                        mean, sd, w = now[i]
                        x = np.column_stack([(part[names].to_numpy(float) - mean) / sd, np.ones(len(part))])
                        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                        one = np.r_[((x * (q * (1 - q))[:, None]).T @ x).ravel(), x.T @ (part["target"].to_numpy(float) - q)]
                        held[i] = held[i] + one if i in held else one
            yield pd.DataFrame({"id": list(held), "sums": [v.tobytes() for v in held.values()]}, dtype=object)

        for r in train.mapInPandas(sums, "id string, sums binary").groupBy("id").applyInPandas(add, "id string, sums binary").collect():
            v = np.frombuffer(r["sums"])
            w = weights[r["id"]]
            step = np.linalg.solve(v[: width * width].reshape(width, width) + ridge * np.eye(width), v[width * width :] - ridge * w)
            weights[r["id"]] = w + step
            if np.abs(step).max() < 1e-8:
                left.discard(r["id"])
    return {i: (*scale[i], w) for i, w in weights.items()}


SCORED = ("date", "glucose_current", "target_value", "target")


def fitted_subject(pdf, params: PredictiveParams) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the logistic model of one subject's training rows."""
    y = pdf["target"].to_numpy(float)
    x = pdf[feature_columns(params)].to_numpy(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    return raw_weights(mean, np.where(sd > 0, sd, 1), fit_weights((x - mean) / np.where(sd > 0, sd, 1), y))


def raw_weights(mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of standardized features as those of the features themselves: coefficients and intercept."""
    coefficients = w[:-1] / sd
    return coefficients, float(w[-1] - coefficients @ mean)


def logistic_models(rows: DataFrame, params: PredictiveParams, most: int) -> DataFrame:
    """``id``, ``coefficients`` and ``intercept`` of a logistic model for each subject of ``rows``: in one task up to ``most`` examples, by sums over all rows above."""
    import pandas as pd

    p, kind = params.normalized(), "id string, coefficients array<double>, intercept double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        coefficients, intercept = fitted_subject(pdf, p)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "coefficients": [coefficients], "intercept": [intercept]}).astype({"id": object})

    train = rows.where("split = 'train'")
    models = train.where(F.col("total") <= most).groupBy("id").applyInPandas(fit, kind)
    large = rows.where(F.col("total") > most)
    if large.limit(1).count():
        found = [(i, *raw_weights(*m)) for i, m in large_subject_weights(large, params).items()]
        if found:
            models = models.unionByName(rows.sparkSession.createDataFrame([(i, c.tolist(), b) for i, c, b in found], kind))
    return stored(models, "models")


def per_subject_models(ex: DataFrame, params: PredictiveParams = PredictiveParams(), most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """One model of the kind that ``params`` asks for per subject: its scores for all the subject's examples, and importances (``id``, ``feature``, ``importance``).

    A logistic model's importances are the sizes of its coefficients, a forest's the decrease of
    impurity.  A subject with too little to learn from has null scores and no importances.  Every
    example trains, is tested and scored; each model is fitted once.
    """
    p, names = params.normalized(), feature_columns(params)
    kept = dict.fromkeys(["id", "timestamp", *SCORED, *names, "split", "total"])
    rows = stored(training_rows(ex).select(*kept, F.monotonically_increasing_id().alias("key")), "examples")
    train = F.col("split") == "train"
    enough = rows.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("n"), F.count_if(train & (F.col("target") == 1)).alias("events"), F.count_if(train & (F.col("target") == 0)).alias("others"))
    enough = enough.where((F.col("n") >= p.min_examples) & (F.least("events", "others") >= p.min_events)).select("__id")
    ready = rows.join(enough, F.col("id") == F.col("__id"), "left_semi")
    if p.model == "random_forest":
        forests = Forests(ready.select("id", "key", "target", train.alias("train"), "total", *names), names, p.trees)
        found = forests.scores().select(F.col("key").alias("__key"), F.col("probability").alias("risk_probability"))
        scores, importance = rows.join(found, F.col("key") == F.col("__key"), "left"), forests.importance()
    else:
        models = logistic_models(ready, params, most)
        scores = rows.join(models.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
        z = sum((F.col(f) * F.col("coefficients")[k] for k, f in enumerate(names)), F.col("intercept"))
        scores = scores.withColumn("risk_probability", F.when(F.col("intercept").isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))))
        importance = models.select("id", F.posexplode("coefficients")).select("id", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("feature"), F.abs("col").alias("importance"))
    return scores.select("id", "timestamp", *SCORED, "split", finite("risk_probability").alias("risk_probability")), importance


def per_subject_scores(ex: DataFrame, params: PredictiveParams = PredictiveParams(), most: int = 100_000) -> DataFrame:
    """The scores of ``per_subject_models``."""
    return per_subject_models(ex, params, most)[0]


def performance(scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the test rows with a score: events, AUC (by midranks), sensitivity, specificity, Brier score; no row where there are none."""
    t = scores.where((F.col("split") == "test") & finite("risk_probability").isNotNull() & F.col("target").isNotNull())
    values = t.groupBy(*by, "risk_probability").agg(F.count("*").alias("n"), F.sum("target").alias("events"), F.sum(F.pow(F.col("risk_probability") - F.col("target"), 2)).alias("error"))
    values = with_sum_below(values, "risk_probability", "n", by).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    hit = F.col("risk_probability") >= threshold
    n, e = F.sum("n"), F.sum("events")
    return values.groupBy(*by).agg(
        n.alias("test_rows"), e.alias("test_events"), ((F.sum(F.col("rank") * F.col("events")) - e * (e + 1) / 2) / F.nullif(e * (n - e), F.lit(0))).alias("auc"),
        (F.coalesce(F.sum(F.when(hit, F.col("events"))), F.lit(0)) / F.nullif(e, F.lit(0))).alias("sensitivity"),
        (F.coalesce(F.sum(F.when(~hit, F.col("n") - F.col("events"))), F.lit(0)) / F.nullif(n - e, F.lit(0))).alias("specificity"), (F.sum("error") / n).alias("brier_score"), F.lit(threshold).alias("threshold"),
    ).where("test_rows > 0")


#: How exports and cards name models, states and features.
MODEL_LABELS = {"logistic": "Logistic regression", "random_forest": "Random forest"}
STATUS_LABELS = {"ready": "Ready", "insufficient_examples": "Needs more rows", "insufficient_features": "Needs features", "insufficient_events": "Needs events"}
FEATURE_LABELS = {"glucose_current": "Current glucose", "time_sin": "Time of day pattern (sine)", "time_cos": "Time of day pattern (cosine)"}
WINDOW_LABELS = {
    "mean": "Mean glucose over previous {} min", "sd": "Glucose variability over previous {} min", "min": "Minimum glucose over previous {} min",
    "max": "Maximum glucose over previous {} min", "slope": "Glucose trend over previous {} min",
}


def feature_label(name: str) -> str:
    """What an export calls a feature; a name that is none of them stays."""
    kind, _, rest = name.partition("_")
    minutes, _, what = rest.partition("_")
    if kind == "lag" and minutes.isdigit() and what == "glucose":
        return f"Glucose {minutes} min ago"
    if kind == "window" and minutes.isdigit() and what in WINDOW_LABELS:
        return WINDOW_LABELS[what].format(minutes)
    return FEATURE_LABELS.get(name, name)


def model_columns(params: PredictiveParams, thresholds: Thresholds) -> dict[str, Column]:
    p = params.normalized()
    return {"Model": F.lit(MODEL_LABELS[p.model]), "Target": F.lit(target_label(p, thresholds)), "Horizon": F.lit(f"{p.horizon_minutes} minutes")}


def scores_export(scores: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Scored examples under the names of the export."""
    names = {"id": "Subject ID", "timestamp": "Timestamp", "date": "Date", "split": "Split", "glucose_current": "Current glucose", "target": "Observed event", "target_value": "Future glucose summary", "risk_probability": "Risk probability"}
    m = model_columns(params, thresholds)
    return scores.select(*(F.col(c).alias(n) for c, n in names.items()), m["Target"].alias("Target"), m["Model"].alias("Model"), m["Horizon"].alias("Horizon"))


def performance_export(perf: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Performance, by ``id`` or of all subjects together (a null subject), rounded as shown."""
    names = {"test_rows": ("Test rows", None), "test_events": ("Test events", None), "auc": ("AUC", 3), "sensitivity": ("Sensitivity", 3), "specificity": ("Specificity", 3), "brier_score": ("Brier score", 3), "threshold": ("Threshold", 2)}
    subject = F.col("id") if "id" in perf.columns else F.lit(None).cast("string")
    return perf.select(subject.alias("Subject ID"), *(c.alias(n) for n, c in model_columns(params, thresholds).items()), *((F.col(c) if d is None else F.round(c, d)).alias(n) for c, (n, d) in names.items()))


def importance_export(importance: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Importances under readable names, largest first within a subject."""
    labels = F.create_map(*(F.lit(x) for f in feature_columns(params) for x in (f, feature_label(f))))
    subject = F.col("id") if "id" in importance.columns else F.lit(None).cast("string")
    return importance.select(subject.alias("Subject ID"), *(c.alias(n) for n, c in model_columns(params, thresholds).items()), F.coalesce(labels[F.col("feature")], "feature").alias("Feature"), F.col("feature").alias("Model input"), F.round("importance", 4).alias("Importance"))


def risk_bundle(ex: DataFrame, params: PredictiveParams = PredictiveParams(), thresholds: Thresholds = Thresholds()) -> dict:
    """All that one selection of examples gives: ``status``, ``message``, ``scores`` (null probabilities where there is no model), ``performance``, ``importance`` and ``cards``."""
    p = params.normalized()
    s = split(stored(ex, "examples"))
    counts = example_counts(s)
    status, message = fit_status(*counts, p)
    if status == "ready":
        scores, importance = fitted_scores(s, p)
    else:
        scores, importance = s.withColumn("risk_probability", F.lit(None).cast("double")), ex.sparkSession.createDataFrame([], "feature string, importance double")
    perf = performance(scores, p.threshold)
    return {"status": status, "message": message, "scores": scores, "performance": perf, "importance": importance, "cards": summary_cards(status, counts[0], perf)}


def summary_cards(status: str, examples_: int, perf: DataFrame) -> DataFrame:
    """``Label`` and ``Value``, as text, of five cards."""
    found = perf.limit(1).collect()  # one row, or none
    shown = lambda name, form: form(found[0][name]) if found and found[0][name] is not None and math.isfinite(found[0][name]) else "Not available"
    digits = lambda x: f"{round(x, 3):g}"
    cards = [("Status", STATUS_LABELS.get(status, "Not ready")), ("Examples", f"{examples_:,}"), ("Test events", shown("test_events", "{:,}".format)), ("AUC", shown("auc", digits)), ("Brier", shown("brier_score", digits))]
    return perf.sparkSession.createDataFrame(cards, "Label string, Value string")


def risk_band(probability: Column, threshold: float = 0.5) -> Column:
    """Low below a floor (a quarter, or half the threshold where that is a quarter at most), elevated up to the threshold, then high."""
    floor = 0.25 if threshold > 0.25 else max(0.01, threshold / 2)
    return F.when(probability >= threshold, "high").when(probability >= floor, "elevated").otherwise("low")

"""Estimates for missing slots of a subject's grid: a state-space smoother, and nearest days.

Both work on days of slots (a row each, values as doubles, NaN where there is none), so a
subject's readings never meet in a task; only a few numbers per day do.

``kalman``: level and slope, the slope a random walk, readings with noise.  A day of slots maps
what is known of the state before it to what is known after it; such maps are composed over the
days before, then every day is filtered from its own start.  Backwards, a day maps the smoothed
state of the next day's first slot to that of its own first slot, an affine map; composed over the days after, they
give each day its end.  The result is that of one smoother over the whole series.

``knn``: the mean, at the same slot, of the ``k`` days most like the day (root mean square
difference over slots that both have) among those up to ``window`` days away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucolake.functions.tables import stored

#: Readings that a subject needs; what is known of level and slope before the first reading (variances).
LEAST_HISTORY, WIDE = 20, (1e6, 1e4)
#: Nearest days, how far away they may be, and the share of a day's slots that two days must both have.
NEIGHBOURS, WINDOW, LEAST_SHARE = 7, 180, 12
_F = np.array([[1.0, 1.0], [0.0, 1.0]])
_I = np.eye(2)


def day_rows(grid: DataFrame, per_day: int) -> DataFrame:
    """``id``, ``day`` and ``y``: the slots of each day of a grid (``slot``, ``glucose``), NaN where there is no value or no slot; stored."""
    d = grid.where(F.col("slot").isNotNull()).select("id", F.floor(F.col("slot") / per_day).alias("day"), F.pmod("slot", F.lit(per_day)).cast("int").alias("at"), "glucose")
    d = d.groupBy("id", "day").agg(F.map_from_entries(F.collect_list(F.struct("at", "glucose"))).alias("held"))  # ``per_day`` at most
    y = F.transform(F.sequence(F.lit(0), F.lit(per_day - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(float("nan"))))
    return stored(d.select("id", "day", y.alias("y")), "days")


def _days(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("y")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def noise(days: DataFrame) -> DataFrame:
    """``id``, ``n`` (readings), ``q`` and ``r``: variances of the slope's steps and of readings, by the moments of second differences within days."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _days(batch)
            d = y[:, 2:] - 2 * y[:, 1:-1] + y[:, :-2]
            both = d[:, 1:] * d[:, :-1]
            columns = [np.isfinite(y).sum(axis=1), np.isfinite(d).sum(axis=1), np.nansum(d * d, axis=1), np.isfinite(both).sum(axis=1), np.nansum(both, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(float)) for c in columns)], ["id", "n", "n0", "s0", "n1", "s1"])

    s = days.select("id", "y").mapInArrow(sums, "id string, n double, n0 double, s0 double, n1 double, s1 double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "s0", "n1", "s1")))
    # Of second differences the variance is q + 6 r and the covariance of neighbours -4 r.
    v, c = F.coalesce(F.try_divide("s0", "n0"), F.lit(1.0)), F.coalesce(F.try_divide("s1", "n1"), F.lit(0.0))
    floor = F.greatest(v, F.lit(1e-6)) * 1e-3
    r = F.greatest(-c / 4, floor)
    return s.select("id", F.col("n").cast("long").alias("n"), F.greatest(v - 6 * r, floor).alias("q"), r.alias("r"))


def element(y: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a slot of each day (values ``y``, NaN for none) does to the state before it: (A, b, C, eta, J), as in filtering by associative scans."""
    n = len(y)
    seen = np.isfinite(y)[:, None, None]
    noise_ = np.zeros((n, 2, 2))
    noise_[:, 1, 1] = q
    # The reading is of the level, whose own step has no noise: S = r, and the gain is nought.
    value = np.nan_to_num(y)
    f0 = _F[0]
    eta = np.where(seen[:, :, 0], f0 * (value / r)[:, None], 0.0)
    j = np.where(seen, np.outer(f0, f0) / r[:, None, None], 0.0)
    return np.broadcast_to(_F, (n, 2, 2)), np.zeros((n, 2)), noise_, eta, j


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """One element for two in a row."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    t = np.swapaxes
    left = a2 @ np.linalg.inv(_I + c1 @ j2)
    right = t(a1, 1, 2) @ np.linalg.inv(_I + j2 @ c1)
    v = lambda m, x: (m @ x[:, :, None])[:, :, 0]
    return left @ a1, v(left, b1 + v(c1, e2)) + b2, left @ c1 @ t(a2, 1, 2) + c2, v(right, e2 - v(j2, b1)) + e1, right @ j2 @ a1 + j1


def forward(y: np.ndarray, q: np.ndarray, r: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered means and covariances of each slot of each day from the state before the day."""
    n, slots = y.shape
    means, covs = np.empty((slots, n, 2)), np.empty((slots, n, 2, 2))
    for k in range(slots):
        mean = mean @ _F.T
        cov = _F @ cov @ _F.T
        cov[:, 1, 1] += q
        seen = np.isfinite(y[:, k])
        gain = np.where(seen[:, None], cov[:, :, 0] / (cov[:, 0, 0] + r)[:, None], 0.0)
        mean = mean + gain * (np.nan_to_num(y[:, k]) - mean[:, 0])[:, None]
        cov = cov - gain[:, :, None] * cov[:, None, 0, :]
        means[k], covs[k] = mean, cov
    return means, covs


def backward_gain(cov: np.ndarray, q: np.ndarray) -> np.ndarray:
    ahead = _F @ cov @ _F.T
    ahead[:, 1, 1] += q
    return cov @ _F.T @ np.linalg.inv(ahead)


def kalman(days: DataFrame, parameters: DataFrame) -> DataFrame:
    """``id``, ``day``, ``values``: smoothed levels of every slot, of subjects in ``parameters`` (``id``, ``q``, ``r``)."""
    p = parameters.select(F.col("id").alias("__id"), "q", "r")
    rows = days.join(p, F.col("id") == F.col("__id")).drop("__id")

    def arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]

    def lists(batch: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, (q, r) = _days(batch), arrays(batch, "q", "r")
            whole = element(y[:, 0], q, r)
            for k in range(1, y.shape[1]):
                whole = compose(whole, element(y[:, k], q, r))
            flat = np.concatenate([x.reshape(len(y), -1) for x in whole], axis=1)
            first = np.where(np.isfinite(y).any(axis=1), y[np.arange(len(y)), np.isfinite(y).argmax(axis=1)], np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(flat), pa.list_(pa.float64())), pa.array(first)], ["id", "day", "map", "first"])

    def starts(table: pa.Table) -> pa.Table:
        """The state before each day of a subject: a row of 14 numbers for each day."""
        table = table.sort_by("day")
        m = np.array(table.column("map").to_pylist())
        values = table.column("first").to_numpy()
        seen = values[np.isfinite(values)]
        mean, cov = np.array([[seen[0] if len(seen) else 0.0, 0.0]]), np.diag(WIDE)[None]
        state = (np.zeros((1, 2, 2)), mean, cov, np.zeros((1, 2)), np.zeros((1, 2, 2)))
        out = []
        for row in m:
            out.append(np.r_[state[1].ravel(), state[2].ravel()])
            state = compose(state, (row[:4].reshape(1, 2, 2), row[4:6][None], row[6:10].reshape(1, 2, 2), row[10:12][None], row[12:16].reshape(1, 2, 2)))
        return pa.table({"id": table.column("id"), "day": table.column("day"), "start": pa.array(out, pa.list_(pa.float64()))})

    found = rows.select("id", "day", "y", "q", "r").mapInArrow(maps, "id string, day long, map array<double>, first double")
    before = found.groupBy("id").applyInArrow(starts, "id string, day long, start array<double>")
    with_start = stored(_with(rows, before, "start"), "filtered")

    def filtered(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        start, (q, r) = lists(batch, "start", 6), arrays(batch, "q", "r")
        return q, *forward(_days(batch), q, r, start[:, :2], start[:, 2:].reshape(-1, 2, 2))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smoothed state of a day's first slot as an affine map of that of the next day's first slot, and the last filtered state."""
        for batch in batches:
            q, means, covs = filtered(batch)
            e, g = np.broadcast_to(_I, covs[0].shape), np.zeros_like(means[0])
            for k in range(len(means) - 1, -1, -1):
                gain = backward_gain(covs[k], q)
                own = means[k] - (gain @ (means[k] @ _F.T)[:, :, None])[:, :, 0]
                e, g = gain @ e, (gain @ g[:, :, None])[:, :, 0] + own
            flat = np.concatenate([e.reshape(len(g), 4), g, means[-1]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(flat), pa.list_(pa.float64()))], ["id", "day", "map"])

    def ends(table: pa.Table) -> pa.Table:
        """The smoothed state of the slot after each day of a subject; after the last one, what its last state foretells."""
        table = table.sort_by([("day", "descending")])
        out, state = [], None
        for row in np.array(table.column("map").to_pylist()):
            state = _F @ row[6:8] if state is None else state
            out.append(state)
            state = row[:4].reshape(2, 2) @ state + row[4:6]
        return pa.table({"id": table.column("id"), "day": table.column("day"), "end": pa.array(out, pa.list_(pa.float64()))})

    after = with_start.select("id", "day", "y", "q", "r", "start").mapInArrow(back, "id string, day long, map array<double>").groupBy("id").applyInArrow(ends, "id string, day long, end array<double>")

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, means, covs = filtered(batch)
            ahead, out = lists(batch, "end", 2), np.empty((len(q), len(means)))
            for k in range(len(means) - 1, -1, -1):
                gain = backward_gain(covs[k], q)
                ahead = means[k] + (gain @ (ahead - means[k] @ _F.T)[:, :, None])[:, :, 0]
                out[:, k] = ahead[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64()))], ["id", "day", "values"])

    return _with(with_start, after, "end").select("id", "day", "y", "q", "r", "start", "end").mapInArrow(smooth, "id string, day long, values array<double>")


def _with(rows: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column of the row of ``other`` for the same subject and day."""
    other = other.select(F.col("id").alias("__id"), F.col("day").alias("__day"), column)
    return rows.join(other, (F.col("id") == F.col("__id")) & (F.col("day") == F.col("__day"))).drop("__id", "__day")


def knn(days: DataFrame, per_day: int, k: int = NEIGHBOURS, window: int = WINDOW) -> DataFrame:
    """``id``, ``day``, ``values``: of slots without a value the mean of the ``k`` days nearest that have one there, NaN where no day has.

    Days of a subject are dealt into blocks of ``window`` days, and each block gets the days of
    its two neighbours as well: a task holds three blocks.  Ties go to the earlier day.
    """
    least = max(1, per_day // LEAST_SHARE)
    block = F.floor(F.col("day") / window)
    dealt = days.withColumn("to", F.explode(F.array(*(F.struct((block + s).alias("block"), F.lit(s == 0).alias("own")) for s in (-1, 0, 1))))).select("id", "day", "y", "to.block", "to.own")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("day").combine_chunks()
        own = table.column("own").to_numpy(zero_copy_only=False)
        day = table.column("day").to_numpy()
        y = table.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(day), -1)
        has = np.isfinite(y)
        x, h = np.where(has, y, 0.0), has.astype(float)
        rows = np.flatnonzero(own & ~has.all(axis=1))
        both = h[rows] @ h.T
        total = (x * x)[rows] @ h.T + h[rows] @ (x * x).T - 2 * x[rows] @ x.T
        apart = np.sqrt(np.maximum(total, 0) / np.maximum(both, 1))
        far = np.abs(day[rows][:, None] - day)
        apart = np.where((both >= least) & (far > 0) & (far <= window), np.round(apart, 9), np.inf)
        out = np.full((len(rows), y.shape[1]), np.nan)
        for n, row in enumerate(rows):
            order = np.argsort(apart[n], kind="stable")
            order = order[np.isfinite(apart[n][order])]
            for slot in np.flatnonzero(~has[row]):
                near = order[has[order, slot]][:k]
                if len(near):
                    out[n, slot] = y[near, slot].mean()
        return pa.table({"id": pa.array([table.column("id")[0].as_py()] * len(rows), pa.string()), "day": pa.array(day[rows], pa.int64()), "values": pa.array(list(out), pa.list_(pa.float64()))})

    return dealt.groupBy("id", "block").applyInArrow(fill, "id string, day long, values array<double>")

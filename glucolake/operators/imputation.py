"""Filling missing glucose: candidates, estimators of our own, provenance flags.

Only rows that were missing are filled.  Estimators work between two observed neighbours or by
days, so a subject's rows never have to meet in a task.  Models named by other tools can be asked for,
but the numbers come from the estimators here: ``imputation_model`` says what was asked for,
``imputation_estimator`` what was used, ``imputation_error`` why a subject's rows came back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucolake.config import interval
from glucolake.functions.columns import MICROS_PER_MINUTE, micros, with_previous
from glucolake.functions.tables import stored
from glucolake.operators import smoothing
from glucolake.operators.missingness import GAP, grid_summary, regular_grid

#: Label and estimator of each model name.
MODELS = {
    "auto": ("Automatic", ""), "arima": ("ARIMA", "linear"), "kalman": ("State-space smoother", "kalman"), "xgboost": ("XGBoost", "profile"), "rf": ("Random forest", "profile"),
    "knn": ("K-nearest neighbours", "knn"), "lightgbm": ("LightGBM", "profile"), "linear": ("Linear", "linear"), "profile": ("Daily profile", "profile"),
}


def normalize_model(name: str | None) -> str:
    key = (name or "auto").strip().lower().replace("random forest", "rf").replace("random_forest", "rf")
    return key if key in MODELS else "auto"


def candidates(df: DataFrame, minutes: int = 5) -> DataFrame:
    """One row: grid rows, missing readings and their rate."""
    return grid_summary(df, minutes).agg(
        F.sum("expanded_rows").alias("expanded_rows"), F.sum("missing_glucose").alias("missing_glucose"), F.sum("explicit_missing_glucose").alias("explicit_missing_glucose"),
        F.sum("estimated_missing_readings").alias("estimated_missing_readings"), F.round(100 * F.sum("missing_glucose") / F.sum("expanded_rows"), 2).alias("missing_glucose_rate"),
    )


def chosen_model(name: str, rate: Column, missing: Column) -> Column:
    """The model of a subject: as named, or by the rate of missing readings; none where nothing is missing."""
    label = F.when(rate <= 5, "arima").otherwise("xgboost") if name == "auto" else F.lit(name)
    return F.when(missing > 0, label).otherwise("none")


def model_by_subject(df: DataFrame, model: str = "auto", minutes: int = 5) -> DataFrame:
    """The estimator of each subject: as named, or by the rate of missing readings (linear up to 5 %)."""
    name = normalize_model(model)
    rate = grid_summary(df, minutes).select("id", "missing_glucose", "missing_glucose_rate")
    return rate.withColumn("model", chosen_model(name, F.col("missing_glucose_rate"), F.col("missing_glucose")))


def impute(df: DataFrame, model: str = "auto", minutes: int = 5, low: float = 39.0, high: float = 500.0) -> DataFrame:
    """The grid with missing glucose filled between observed neighbours and ``imputed_flag`` set there.

    ``linear``: on the line between the neighbours.  ``profile``: that line, with half the
    subject's usual departure at that time of day from its mean.  Values stay within limits;
    what lies before a subject's first or after its last reading stays missing.

    ``kalman`` and ``knn`` are those of ``smoothing``; a slot for which no day is near enough gets the
    line.  A subject with fewer than ``LEAST_HISTORY`` readings comes back as it was, with an error.
    """
    minutes = interval(minutes)
    grid = stored(regular_grid(df, minutes), "grid")  # read for neighbours, for means by hour and for the result
    placed = grid.where(F.col("slot").isNotNull())
    seen = with_previous(placed.where(F.col("glucose").isNotNull()).select("id", "slot", "timestamp", "_ord", "glucose"), {"s0": F.col("slot"), "g0": F.col("glucose")}, order=("timestamp",))
    between = seen.where(F.col("slot") - F.col("s0") > 1).select("id", F.col("s0"), F.col("slot").alias("s1"), "g0", F.col("glucose").alias("g1"), F.explode(F.sequence(F.col("s0") + 1, F.col("slot") - 1)).alias("slot"))
    step = F.col("slot") - F.col("s0")
    line = F.col("g0") + (F.col("g1") - F.col("g0")) * step / (F.col("s1") - F.col("s0"))
    fills = between.select(F.col("id").alias("fid"), F.col("slot").alias("fslot"), line.alias("line"), (F.least(step, F.col("s1") - F.col("slot")) >= 3).alias("inner"))
    # Means by hour, the overall mean and the model all come from one table of at most 25 rows a subject.
    seen_here = F.when(F.col("slot").isNotNull(), F.col("glucose"))
    hours = grid.groupBy(F.col("id").alias("hid"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("glucose").isNull()).alias("missing"), F.sum(seen_here).alias("total"), F.count(seen_here).alias("seen"))
    whole = Window.partitionBy("hid")
    missing = F.sum("missing").over(whole)
    hours = hours.select(
        "hid", "hour", (F.col("total") / F.nullif(F.col("seen"), F.lit(0))).alias("at_hour"), (F.sum("total").over(whole) / F.nullif(F.sum("seen").over(whole), F.lit(0))).alias("overall"),
        chosen_model(normalize_model(model), F.round(100 * missing / F.sum("n").over(whole), 2), missing).alias("imputation_model"),
    )
    d = grid.join(fills, (grid["id"] == fills["fid"]) & (grid["slot"] == fills["fslot"]), "left")
    d = d.join(hours, F.col("id").eqNullSafe(F.col("hid")) & F.hour("timestamp").eqNullSafe(F.col("hour")), "left")
    estimators = F.create_map(*(F.lit(x) for k, v in MODELS.items() if v[1] for x in (k, v[1])))
    by_profile = (estimators[F.col("imputation_model")] == "profile") & F.col("inner")
    error = F.lit(None).cast("string")
    estimator = MODELS[normalize_model(model)][1]
    if estimator in ("kalman", "knn"):
        days = smoothing.day_rows(grid, per_day := max(1, 1440 // minutes))
        known = smoothing.noise(days)
        able = known.where(F.col("n") >= smoothing.LEAST_HISTORY)
        found = smoothing.kalman(days, able) if estimator == "kalman" else smoothing.knn(days.join(able.select("id"), "id", "left_semi"), per_day)
        found = found.select(F.col("id").alias("eid"), "day", F.posexplode("values").alias("at", "estimate")).where(~F.isnan("estimate")).select("eid", (F.col("day") * per_day + F.col("at")).alias("eslot"), "estimate")
        d = d.join(found, (F.col("id") == F.col("eid")) & (F.col("slot") == F.col("eslot")), "left")
        d = d.join(known.select(F.col("id").alias("nid"), F.col("n").alias("readings")), F.col("id") == F.col("nid"), "left")
        few = (F.col("imputation_model") != "none") & (F.coalesce("readings", F.lit(0)) < smoothing.LEAST_HISTORY)
        error = F.when(few, F.concat(F.lit(f"Needs at least {smoothing.LEAST_HISTORY} readings; has "), F.coalesce("readings", F.lit(0)), F.lit(".")))
        estimate = F.when(~few, F.when(F.col("line").isNotNull(), F.coalesce("estimate", "line")))
        d = d.withColumn("line", estimate)
    value = F.least(F.lit(high), F.greatest(F.lit(low), F.col("line") + F.when(by_profile, 0.5 * F.coalesce(F.col("at_hour") - F.col("overall"), F.lit(0.0))).otherwise(0.0)))
    fill = F.col("glucose").isNull() & F.col("line").isNotNull()
    return d.withColumns({"glucose": F.when(fill, value).otherwise(F.col("glucose")), "imputed_flag": F.col("imputed_flag") | F.coalesce(fill, F.lit(False))}).select(*grid.columns, "imputation_model", F.coalesce(estimators[F.col("imputation_model")], F.lit("none")).alias("imputation_estimator"), error.alias("imputation_error"))


def apply_result(df: DataFrame, result: DataFrame) -> DataFrame:
    """Values of an outside model (``_ord``, ``imputed_glucose``) put where glucose was missing, flagged; NaN and infinite ones are ignored."""
    r = result.select(F.col("_ord").alias("__o"), F.col("imputed_glucose").alias("__g")).where(~F.isnan("__g") & (F.abs(F.col("__g")) < float("inf")))
    d = df.join(r, F.col("_ord") == F.col("__o"), "left")
    fill = F.col("glucose").isNull() & F.col("__g").isNotNull()
    flag = F.coalesce(F.col("imputed_flag"), F.lit(False)) if "imputed_flag" in df.columns else F.lit(False)
    return d.withColumns({"imputed_flag": flag | fill, "glucose": F.coalesce("glucose", "__g")}).drop("__o", "__g")


def status(df: DataFrame, imputed: DataFrame, minutes: int = 5) -> DataFrame:
    """Per subject: missing before, filled, missing after, and what became of the request."""
    before = grid_summary(df, minutes).select("id", F.col("missing_glucose").alias("missing_before"))
    after = imputed.groupBy(F.col("id").alias("aid")).agg(F.count_if(F.col("imputed_flag") & F.col("glucose").isNotNull()).alias("filled"), F.count_if(F.col("glucose").isNull()).alias("missing_after"), F.max("imputation_model").alias("imputation_model"))
    text = F.when(F.col("missing_before") == 0, "No missing glucose").when(F.col("missing_after") == 0, "Complete").when(F.col("filled") > 0, "Partly filled").otherwise("Nothing filled")
    return before.join(after, F.col("id").eqNullSafe(F.col("aid")), "left").drop("aid").withColumn("status", text)


def from_gaps(imputed: DataFrame) -> DataFrame:
    """Filled rows that had no row of their own before."""
    return imputed.where(F.col("imputed_flag") & (F.col("missing_source") == GAP))


def minutes_between(a: str, b: str):
    return (micros(b) - micros(a)) / MICROS_PER_MINUTE

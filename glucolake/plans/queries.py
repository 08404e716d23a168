"""Every operator as a query over the driver's tables, with independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucolake.config import ComplexityParams, FunctionalParams, PredictiveParams
from glucolake.operators import complexity, downsample, export, functional, imputation, metrics, missingness, predictive, quality, review, scope, stats
from glucolake.plans.fixtures import DENSE, SPARSE, TEXT, plain, plain_sql, readings, text_readings
from glucolake.sources import standardize as std

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MINUTES = 60  # grid interval of the missingness queries

PERIODS = f"""WITH {DENSE},
p AS (SELECT *, unnest(CASE WHEN mod >= 360 THEN ['full_day', 'daytime'] ELSE ['full_day', 'nighttime'] END) AS metric_period FROM g)"""
KEYS = 'id, id_source, "group", metric_period'
BASE = f"""SELECT {KEYS}, count(glucose) AS readings, avg(glucose) AS mean_glucose, quantile_cont(glucose, 0.5) AS median_glucose, stddev_samp(glucose) AS sd_glucose,
 100 * stddev_samp(glucose) / nullif(avg(glucose), 0) AS cv_percent, min(glucose) AS min_glucose, max(glucose) AS max_glucose,
 100.0::DOUBLE * count_if(glucose BETWEEN 70 AND 180) / nullif(count(glucose), 0) AS tir_percent, 100.0::DOUBLE * count_if(glucose < 70) / nullif(count(glucose), 0) AS tbr_percent,
 100.0::DOUBLE * count_if(glucose > 180) / nullif(count(glucose), 0) AS tar_percent, 100.0::DOUBLE * count_if(glucose < 54) / nullif(count(glucose), 0) AS tbr_level2_percent,
 100.0::DOUBLE * count_if(glucose >= 54 AND glucose < 70) / nullif(count(glucose), 0) AS tbr_level1_percent, 100.0::DOUBLE * count_if(glucose > 180 AND glucose <= 250) / nullif(count(glucose), 0) AS tar_level1_percent,
 100.0::DOUBLE * count_if(glucose > 250) / nullif(count(glucose), 0) AS tar_level2_percent, 3.31 + 0.02392 * avg(glucose) AS gmi_percent FROM p GROUP BY {KEYS}"""
BASE_COLUMNS = "id:s id_source:s group:s metric_period:s readings:i mean_glucose:d median_glucose:d sd_glucose:d cv_percent:d min_glucose:d max_glucose:d tir_percent:d tbr_percent:d tar_percent:d tbr_level2_percent:d tbr_level1_percent:d tar_level1_percent:d tar_level2_percent:d gmi_percent:d"


def query(name: str, sql: str | None = None, columns: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = plain_sql(sql, columns)
        return f

    return keep


@query("base_metrics_periods", f"{PERIODS}\nFINAL {BASE}", BASE_COLUMNS)
def base_metrics_periods(spark, d):
    return metrics.base_metrics(metrics.with_periods(readings(spark, d)))


@query("base_metrics_sparse", f"WITH {SPARSE}, p AS (SELECT *, 'full_day' AS metric_period FROM g)\nFINAL {BASE}", BASE_COLUMNS)
def base_metrics_sparse(spark, d):
    return metrics.base_metrics(readings(spark, d, dense=False).withColumn("metric_period", F.lit("full_day")))


@query("metrics_long", f"""{PERIODS}, b AS ({BASE})
FINAL SELECT {KEYS}, metric AS raw_name, round(value, CASE metric WHEN 'readings' THEN 0 WHEN 'gmi_percent' THEN 2 ELSE 1 END) AS value
 FROM (SELECT {KEYS}, CAST(readings AS DOUBLE) AS readings, * EXCLUDE (id, id_source, "group", metric_period, readings) FROM b) UNPIVOT (value FOR metric IN (COLUMNS(* EXCLUDE (id, id_source, "group", metric_period))))""",
    "id:s id_source:s group:s metric_period:s raw_name:s value:d")
def metrics_long(spark, d):
    return metrics.metrics_long(metrics.base_metrics(metrics.with_periods(readings(spark, d)))).select("id", "id_source", "group", "metric_period", "raw_name", "value")


@query("tir_long", f"""WITH {DENSE}
FINAL SELECT id, id_source, "group", unnest(['Below range', 'In range', 'Above range']) AS range, unnest([100.0 * count_if(glucose < 70) / count(glucose), 100.0 * count_if(glucose BETWEEN 70 AND 180) / count(glucose), 100.0 * count_if(glucose > 180) / count(glucose)]) AS percent
 FROM g GROUP BY id, id_source, "group" """, "id:s id_source:s group:s range:s percent:d")  # fmt: skip
def tir_long(spark, d):
    return metrics.tir_long(metrics.base_metrics(metrics.with_periods(readings(spark, d))))


@query("risk_metrics", f"""{PERIODS}, r AS (SELECT {KEYS}, CASE WHEN glucose > 0 THEN glucose END AS x, CASE WHEN glucose > 1 THEN 1.509::DOUBLE * (pow(ln(glucose), 1.084) - 5.381) END AS f FROM p)
FINAL SELECT {KEYS}, coalesce(sum(CASE WHEN f < 0 THEN 10 * f * f END), 0) / nullif(count(x), 0) AS lbgi, coalesce(sum(CASE WHEN f > 0 THEN 10 * f * f END), 0) / nullif(count(x), 0) AS hbgi,
 0.001::DOUBLE * pow(avg(x) + stddev_samp(x), 2) AS j_index FROM r GROUP BY {KEYS}""", "id:s id_source:s group:s metric_period:s lbgi:d hbgi:d j_index:d")  # fmt: skip
def risk_metrics(spark, d):
    return metrics.risk_metrics(metrics.with_periods(readings(spark, d)))


@query("mage", f"""{PERIODS}, v AS (SELECT {KEYS}, glucose, timestamp, _ord, lag(glucose) OVER w AS a, lead(glucose) OVER w AS b FROM p WHERE glucose IS NOT NULL WINDOW w AS (PARTITION BY {KEYS} ORDER BY timestamp, _ord)),
e AS (SELECT *, abs(glucose - lag(glucose) OVER (PARTITION BY {KEYS} ORDER BY timestamp, _ord)) AS step FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND ((glucose >= a AND glucose > b) OR (glucose <= a AND glucose < b))),
s AS (SELECT {KEYS}, stddev_samp(glucose) AS sd, count(*) AS n FROM v GROUP BY {KEYS})
FINAL SELECT s.id, s.id_source, s."group", s.metric_period, avg(CASE WHEN n >= 4 AND step >= sd THEN step END) AS mage FROM s LEFT JOIN e USING ({KEYS}) GROUP BY s.id, s.id_source, s."group", s.metric_period""",
    "id:s id_source:s group:s metric_period:s mage:d")
def mage(spark, d):
    return metrics.mage(metrics.with_periods(readings(spark, d)))


@query("lag_metrics", f"""WITH {DENSE}, v AS (SELECT id, us, glucose, _ord FROM g WHERE glucose IS NOT NULL),
i AS (SELECT id, (us - lag(us) OVER (PARTITION BY id ORDER BY us, glucose)) / 1e6::DOUBLE AS gap FROM v),
m AS (SELECT id, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) AS md, min(gap) AS lo, max(gap) AS hi FROM i GROUP BY id),
t AS (SELECT id, CASE WHEN greatest(hi - md, md - lo) <= greatest(1, 1e-6 * md) THEN 0 ELSE greatest(60, 0.51::DOUBLE * md) END AS tol FROM m),
l AS (SELECT v.*, tol, lag, us + lag::BIGINT * 1000000 AS target FROM v JOIN t USING (id), (VALUES (43200), (86400)) AS x(lag)),
n AS (SELECT l.id, l.us, l._ord, l.lag, l.glucose, arg_min(r.glucose, abs(r.us - l.target) * 2 + CASE WHEN r.us > l.target THEN 1 ELSE 0 END) AS later FROM l JOIN v r ON l.id = r.id AND abs(r.us - l.target) <= l.tol * 1000000 GROUP BY ALL)
FINAL SELECT id, stddev_samp(CASE WHEN lag = 43200 THEN later - glucose END) AS conga_12h, stddev_samp(CASE WHEN lag = 86400 THEN later - glucose END) AS conga_24h, avg(CASE WHEN lag = 86400 THEN abs(later - glucose) END) AS modd
 FROM (SELECT DISTINCT id FROM g) LEFT JOIN n USING (id) GROUP BY id""", "id:s conga_12h:d conga_24h:d modd:d")  # fmt: skip
def lag_metrics(spark, d):
    return metrics.lag_metrics(readings(spark, d), ["id"])


RISK = f"""SELECT {KEYS}, coalesce(sum(CASE WHEN f < 0 THEN 10 * f * f END), 0) / nullif(count(x), 0) AS lbgi, coalesce(sum(CASE WHEN f > 0 THEN 10 * f * f END), 0) / nullif(count(x), 0) AS hbgi, 0.001::DOUBLE * pow(avg(x) + stddev_samp(x), 2) AS j_index
 FROM (SELECT {KEYS}, CASE WHEN glucose > 0 THEN glucose END AS x, CASE WHEN glucose > 1 THEN 1.509::DOUBLE * (pow(ln(glucose), 1.084) - 5.381) END AS f FROM p) GROUP BY {KEYS}"""
CORE = f"""{PERIODS}, base AS ({BASE}), risk AS ({RISK}), v AS (SELECT {KEYS}, us, timestamp, glucose, _ord FROM p WHERE glucose IS NOT NULL),
nb AS (SELECT *, lag(glucose) OVER w AS a, lead(glucose) OVER w AS b, (us - lag(us) OVER (PARTITION BY {KEYS} ORDER BY us, glucose)) / 1e6::DOUBLE AS gap FROM v WINDOW w AS (PARTITION BY {KEYS} ORDER BY timestamp, _ord)),
tn AS (SELECT {KEYS}, abs(glucose - lag(glucose) OVER (PARTITION BY {KEYS} ORDER BY timestamp, _ord)) AS step FROM nb WHERE a IS NOT NULL AND b IS NOT NULL AND ((glucose >= a AND glucose > b) OR (glucose <= a AND glucose < b))),
mg AS (SELECT {KEYS}, avg(CASE WHEN readings >= 4 AND step >= sd_glucose THEN step END) AS mage FROM base LEFT JOIN tn USING ({KEYS}) GROUP BY {KEYS}),
md AS (SELECT {KEYS}, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) AS md, min(gap) AS lo, max(gap) AS hi FROM nb GROUP BY {KEYS}),
tl AS (SELECT {KEYS}, CASE WHEN greatest(hi - md, md - lo) <= greatest(1, 1e-6 * md) THEN 0 ELSE greatest(60, 0.51::DOUBLE * md) END AS tol FROM md),
lt AS (SELECT v.*, tol, lag, us + lag::BIGINT * 1000000 AS target FROM v JOIN tl USING ({KEYS}), (VALUES (43200), (86400)) AS x(lag)),
nr AS (SELECT l.id, l.id_source, l."group", l.metric_period, l.lag, l.glucose, arg_min(r.glucose, abs(r.us - l.target) * 2 + CASE WHEN r.us > l.target THEN 1 ELSE 0 END) AS later FROM lt l JOIN v r ON l.id = r.id AND l.metric_period = r.metric_period AND abs(r.us - l.target) <= l.tol * 1000000 GROUP BY l.id, l.id_source, l."group", l.metric_period, l.lag, l.us, l._ord, l.glucose),
lg AS (SELECT {KEYS}, stddev_samp(CASE WHEN lag = 43200 THEN later - glucose END) AS conga_12h, stddev_samp(CASE WHEN lag = 86400 THEN later - glucose END) AS conga_24h, avg(CASE WHEN lag = 86400 THEN abs(later - glucose) END) AS modd FROM nr GROUP BY {KEYS})"""


@query("core_metrics", f"""{CORE}
FINAL SELECT *, CASE WHEN coalesce(conga_12h, conga_24h, modd) IS NULL THEN 'unavailable' ELSE 'ok' END AS lag_status, CASE WHEN lbgi IS NULL THEN 'unavailable' ELSE 'ok' END AS risk_status, 'base+lag+risk' AS metric_engine
 FROM base LEFT JOIN lg USING ({KEYS}) LEFT JOIN risk USING ({KEYS}) LEFT JOIN mg USING ({KEYS})""",
    f"{BASE_COLUMNS} conga_12h:d conga_24h:d modd:d lbgi:d hbgi:d j_index:d mage:d lag_status:s risk_status:s metric_engine:s")
def core_metrics(spark, d):
    return metrics.core_metrics(readings(spark, d))


DIGITS = "CASE metric " + " ".join(f"WHEN '{raw}' THEN {digits}" for raw, _, _, _, digits, _ in metrics.catalog()) + " END"
CORE_ROWS = f"""{CORE}, cm AS (SELECT {KEYS}, CAST(readings AS DOUBLE) AS readings, * EXCLUDE ({KEYS}, readings) FROM base LEFT JOIN lg USING ({KEYS}) LEFT JOIN risk USING ({KEYS}) LEFT JOIN mg USING ({KEYS})),
ml AS (SELECT {KEYS}, metric AS raw_name, round(value, {DIGITS}) AS value FROM cm UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE ({KEYS})))))"""


@query("metrics_export", f"{CORE_ROWS}\nFINAL SELECT * FROM ml", "id:s id_source:s group:s metric_period:s raw_name:s value:d")
def metrics_export(spark, d):
    return export.complete_metrics(readings(spark, d)).select("id", "id_source", "group", "metric_period", "raw_name", "value")


@query("metrics_cached_export", f"""{CORE_ROWS}
FINAL SELECT id, "group", raw_name, value, NULL AS status, NULL AS definition FROM ml WHERE id < 'S3' UNION ALL
 SELECT id, "group", NULL, NULL, CASE WHEN id < 'S3' THEN 'Generated' ELSE 'Not generated' END, 'Selected-on-demand Metrics cache coverage at export time.' FROM (SELECT DISTINCT id, "group" FROM g)""",
    "id:s group:s raw_name:s value:d status:s definition:s")
def metrics_cached_export(spark, d):
    """Metrics of some subjects, and for all of them whether they are there."""
    r = readings(spark, d)
    return export.cached_metrics(metrics.core_metrics(r.where("id < 'S3'")), r).select("id", "group", "raw_name", "value", "status", "definition")


@query("agp", f"""WITH {DENSE}
FINAL SELECT floor(mod / 30) * 30 + 15 AS time_minutes, quantile_cont(glucose, 0.05) AS q05, quantile_cont(glucose, 0.25) AS q25, quantile_cont(glucose, 0.5) AS median, quantile_cont(glucose, 0.75) AS q75, quantile_cont(glucose, 0.95) AS q95, count(*) AS n
 FROM g WHERE glucose IS NOT NULL GROUP BY 1""", "time_minutes:d q05:d q25:d median:d q75:d q95:d n:i")  # fmt: skip
def agp(spark, d):
    return metrics.agp(readings(spark, d))


@query("data_signature", f"""WITH {DENSE}
FINAL SELECT count(*) AS rows, count(DISTINCT id) AS participants, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, count_if(glucose IS NULL) AS missing_glucose, round(sum(glucose), 4) AS glucose_sum, 0 AS imputed_rows FROM g""",
    "rows:i participants:i first_timestamp:t last_timestamp:t missing_glucose:i glucose_sum:d imputed_rows:i")
def data_signature(spark, d):
    return metrics.data_signature(readings(spark, d))


QC = f"""WITH {DENSE}, l AS (SELECT *, (us - lag(us) OVER (PARTITION BY id ORDER BY us, _ord)) / 6e7::DOUBLE AS gap FROM g),
m AS (SELECT id, quantile_cont(gap, 0.5) AS md FROM l WHERE gap > 0 GROUP BY id),
dd AS (SELECT id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM g GROUP BY ALL),
vd AS (SELECT dd.id, count(*) AS observed_days, count_if(n * md / 60 >= 14) AS valid_days FROM dd JOIN m USING (id) GROUP BY dd.id),
q AS (SELECT l.id, count(*) AS readings, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, any_value(observed_days) AS observed_days, any_value(valid_days) AS valid_days, any_value(md) AS median_interval_minutes,
 100.0::DOUBLE * count(glucose) / (floor((max(us) - min(us)) / 6e7::DOUBLE / any_value(md)) + 1) AS wear_time_percent, count_if(glucose IS NULL) AS missing_glucose, count(*) - count(DISTINCT timestamp) AS duplicate_timestamps,
 count_if(glucose < 40 OR glucose > 400) AS implausible_values, count_if(gap > 1.5 * md) AS gap_count, max(gap) AS max_gap_minutes FROM l JOIN m USING (id) JOIN vd USING (id) GROUP BY l.id)"""
QC_COLUMNS = "readings:i first_timestamp:t last_timestamp:t observed_days:i valid_days:i median_interval_minutes:d wear_time_percent:d missing_glucose:i duplicate_timestamps:i implausible_values:i gap_count:i max_gap_minutes:d"


@query("qc_summary", f"{QC}\nFINAL SELECT * FROM q", f"id:s {QC_COLUMNS}")
def qc_summary(spark, d):
    return quality.qc_summary(readings(spark, d))


@query("qc_review", f"""{QC}
FINAL SELECT *, CASE WHEN notes = '' THEN 'OK' ELSE 'Review' END AS qc_status, CASE WHEN notes = '' THEN 'No review flags' ELSE notes END AS review_notes FROM (SELECT *, concat_ws('; ', CASE WHEN missing_glucose > 0 THEN missing_glucose || ' missing glucose row(s)' END, CASE WHEN gap_count > 0 THEN gap_count || ' timestamp gap(s)' END,
 CASE WHEN duplicate_timestamps > 0 THEN duplicate_timestamps || ' duplicate timestamp(s)' END, CASE WHEN implausible_values > 0 THEN implausible_values || ' glucose value(s) outside review range' END, CASE WHEN valid_days = 0 THEN 'No valid CGM days' END, CASE WHEN wear_time_percent < 80 THEN 'Coverage below 80%' END) AS notes FROM q)""",
    f"id:s qc_status:s review_notes:s {QC_COLUMNS}")
def qc_review(spark, d):
    return quality.qc_review(quality.qc_summary(readings(spark, d)))


@query("median_interval", f"{QC}\nFINAL SELECT id, md AS median_interval_minutes FROM m", "id:s median_interval_minutes:d")
def median_interval(spark, d):
    return quality.median_interval(readings(spark, d))


@query("study_window", f"""WITH {SPARSE}, s AS (SELECT id, min(CAST(timestamp AS DATE)) AS first_date, max(CAST(timestamp AS DATE)) AS last_date, date_diff('day', min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE))) + 1 AS observed_days FROM g GROUP BY id)
FINAL SELECT *, 28 AS expected_days, greatest(0, 28 - observed_days) AS shortfall_days, CASE WHEN observed_days < 28 THEN 'Short observed span' ELSE 'Complete observed span' END AS status FROM s""",
    "id:s first_date:D last_date:D observed_days:i expected_days:i shortfall_days:i status:s")
def study_window(spark, d):
    return scope.study_window(readings(spark, d, dense=False), 28)


@query("date_range_filter", f"""WITH {DENSE}
FINAL SELECT id, count(*) AS n, count(glucose) AS observed FROM g WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY id""", "id:s n:i observed:i")  # fmt: skip
def date_range_filter(spark, d):
    return scope.filter_dates(readings(spark, d), "2024-01-12", "2024-01-05").groupBy("id").agg(F.count("*").alias("n"), F.count("glucose").alias("observed"))


@query("time_window_filter", f"""WITH {DENSE}
FINAL SELECT id, 'daytime' AS time_window, count(*) AS n FROM g WHERE mod >= 360 GROUP BY id UNION ALL SELECT id, 'nighttime', count(*) FROM g WHERE mod < 360 GROUP BY id""", "id:s time_window:s n:i")  # fmt: skip
def time_window_filter(spark, d):
    r = readings(spark, d)
    one = lambda w: scope.filter_time_window(r, w).groupBy("id").agg(F.lit(w).alias("time_window"), F.count("*").alias("n"))
    return one("daytime").unionByName(one("nighttime"))


@query("subject_filter", f"""WITH {SPARSE}\nFINAL SELECT id, "group", sex, count(*) AS n FROM g WHERE "group" = 'Control' AND sex = 'F' GROUP BY ALL""", "id:s group:s sex:s n:i")
def subject_filter(spark, d):
    return scope.filter_values(readings(spark, d, dense=False), group="Control", sex=["F"], id="all").groupBy("id", "group", "sex").agg(F.count("*").alias("n"))


SNAP = f"""WITH {DENSE}, a AS (SELECT *, min(us) OVER (PARTITION BY id) AS anchor FROM g),
b AS (SELECT *, CAST(round_even((us - anchor) / {MINUTES * 60_000_000}.0::DOUBLE, 0) AS BIGINT) AS slot FROM a),
s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY glucose IS NULL, _ord) = 1),
k AS (SELECT id, anchor, min(slot) AS lo, max(slot) AS hi FROM s GROUP BY ALL),
x AS (SELECT k.id, k.anchor, unnest(range(lo, hi + 1)) AS slot FROM k),
e AS (SELECT x.id, x.slot, make_timestamp(x.anchor + x.slot * {MINUTES * 60_000_000}) AS timestamp, s.glucose, s.slot IS NULL AS inserted, s.slot IS NOT NULL AND s.glucose IS NULL AS explicit FROM x LEFT JOIN s USING (id, slot)),
gs AS (SELECT id, count(*) AS expanded_rows, count_if(explicit) AS explicit_missing_glucose, count_if(inserted) AS estimated_missing_readings, count_if(glucose IS NULL) AS missing_glucose, round(100.0::DOUBLE * count_if(glucose IS NULL) / count(*), 2) AS missing_glucose_rate FROM e GROUP BY id),
gp AS (SELECT id, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) * {MINUTES}.0 AS gap_minutes, {MINUTES}.0 AS expected_interval_minutes, count(*) AS estimated_missing_readings FROM (SELECT *, slot - row_number() OVER (PARTITION BY id ORDER BY slot) AS island FROM e WHERE inserted) GROUP BY id, island)"""
GRID_COLUMNS = "id:s expanded_rows:i explicit_missing_glucose:i estimated_missing_readings:i missing_glucose:i missing_glucose_rate:d"


@query("grid_summary_fast", f"{SNAP}\nFINAL SELECT * FROM gs", GRID_COLUMNS)
def grid_summary_fast(spark, d):
    return missingness.grid_summary(readings(spark, d), MINUTES)


@query("grid_summary_expanded", f"{SNAP}\nFINAL SELECT * FROM gs", GRID_COLUMNS)
def grid_summary_expanded(spark, d):
    return missingness.grid_summary_of(missingness.regular_grid(readings(spark, d), MINUTES))


@query("regular_grid", f"{SNAP}\nFINAL SELECT id, timestamp, glucose, inserted AS inserted_timestamp_gap, explicit AS explicit_missing_glucose, CASE WHEN inserted THEN 'timestamp_gap' WHEN explicit THEN 'explicit_na' ELSE 'observed' END AS missing_source FROM e",
    "id:s timestamp:t glucose:d inserted_timestamp_gap:b explicit_missing_glucose:b missing_source:s")
def regular_grid(spark, d):
    return missingness.regular_grid(readings(spark, d), MINUTES).select("id", "timestamp", "glucose", "inserted_timestamp_gap", "explicit_missing_glucose", "missing_source")


@query("gap_periods", f"{SNAP}\nFINAL SELECT * FROM gp", "id:s gap_start:t gap_end:t gap_minutes:d expected_interval_minutes:d estimated_missing_readings:i")
def gap_periods(spark, d):
    return missingness.gap_periods(readings(spark, d), MINUTES)


HEAT = f"""{SNAP}, h AS (SELECT e.id, CAST(e.timestamp AS DATE) AS date, count(*) AS expanded_rows, count_if(glucose IS NULL) AS missing_glucose, round(100.0::DOUBLE * count_if(glucose IS NULL) / count(*), 2) AS missing_glucose_rate, 0 AS imputed_rows, count_if(inserted) AS estimated_missing_readings FROM e GROUP BY ALL),
r AS (SELECT id, CAST(timestamp AS DATE) AS date, count(*) AS readings FROM g GROUP BY ALL), tg AS (SELECT id, CAST(gap_start AS DATE) AS date, count(*) AS timestamp_gaps FROM gp GROUP BY ALL),
hm AS (SELECT h.*, coalesce(readings, 0) AS readings, coalesce(timestamp_gaps, 0) AS timestamp_gaps FROM h LEFT JOIN r USING (id, date) LEFT JOIN tg USING (id, date))"""


@query("daily_heatmap", f"{HEAT}\nFINAL SELECT * FROM hm", "id:s date:D readings:i expanded_rows:i missing_glucose:i missing_glucose_rate:d imputed_rows:i estimated_missing_readings:i timestamp_gaps:i")
def daily_heatmap(spark, d):
    return missingness.daily_heatmap(readings(spark, d), MINUTES).drop("tooltip")


CALENDAR = f"""{HEAT}, sp AS (SELECT id, unnest(generate_series(min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE)), INTERVAL 1 DAY))::DATE AS date FROM g GROUP BY id),
c AS (SELECT sp.id, sp.date, coalesce(hm.readings, 0) AS readings, coalesce(missing_glucose, 0) AS missing_glucose, missing_glucose_rate, coalesce(timestamp_gaps, 0) AS timestamp_gaps, coalesce(estimated_missing_readings, 0) AS estimated_missing_readings,
 coalesce(imputed_rows, 0) AS imputed_rows, {1440 // MINUTES} AS expected_readings, least(100, round(100.0::DOUBLE * coalesce(hm.readings, 0) / {1440 // MINUTES}, 1)) AS coverage_percent FROM sp LEFT JOIN hm USING (id, date)),
cc AS (SELECT *, CASE WHEN readings = 0 THEN 'No data' WHEN coverage_percent < 50 THEN 'Low coverage (<50%)' WHEN coverage_percent < 80 THEN 'Partial coverage (50-79%)' ELSE 'High coverage (>=80%)' END AS coverage_status, strftime(date, '%Y-%m') AS month, isodow(date) AS weekday FROM c)"""


@query("coverage_calendar", f"""{CALENDAR}
FINAL SELECT cc.*, w.week_index, mo.month_offset, mo.month_offset + w.week_index AS plot_x, (i.k - 1) * 8 + cc.weekday AS plot_y FROM cc
 JOIN (SELECT month, wk, dense_rank() OVER (PARTITION BY month ORDER BY wk) - 1 AS week_index FROM (SELECT DISTINCT month, date_trunc('week', date) AS wk FROM cc)) w ON w.month = cc.month AND w.wk = date_trunc('week', cc.date)
 JOIN (SELECT month, coalesce(sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS month_offset FROM (SELECT month, count(DISTINCT date_trunc('week', date)) AS n FROM cc GROUP BY month)) mo ON mo.month = cc.month
 JOIN (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM cc)) i ON i.id = cc.id""",
    "id:s date:D readings:i missing_glucose:i missing_glucose_rate:d timestamp_gaps:i estimated_missing_readings:i imputed_rows:i expected_readings:d coverage_percent:d coverage_status:s month:s weekday:i week_index:i month_offset:i plot_x:i plot_y:i")
def coverage_calendar(spark, d):
    return missingness.coverage_calendar(readings(spark, d), MINUTES)


@query("day_coverage_warnings", f"{CALENDAR}\nFINAL SELECT id, count_if(readings = 0) AS full_missing_days, count_if(readings > 0 AND coverage_percent < 50) AS half_day_or_worse_days FROM cc GROUP BY id", "id:s full_missing_days:i half_day_or_worse_days:i")
def day_coverage_warnings(spark, d):
    return missingness.day_warnings(missingness.coverage_calendar(readings(spark, d), MINUTES))


@query("missingness_summary", f"""{SNAP}{QC.removeprefix(f"WITH {DENSE}")}, pc AS (SELECT id, count(*) AS gaps, sum(estimated_missing_readings) AS hidden FROM gp GROUP BY id)
FINAL SELECT q.id, q.readings, gs.expanded_rows, gs.missing_glucose, gs.missing_glucose_rate, gs.explicit_missing_glucose, coalesce(gaps, 0) AS gap_count, max_gap_minutes, valid_days, observed_days, median_interval_minutes, duplicate_timestamps,
 coalesce(hidden, 0) AS estimated_missing_readings FROM q JOIN gs ON gs.id = q.id LEFT JOIN pc ON pc.id = q.id""",
    "id:s readings:i expanded_rows:i missing_glucose:i missing_glucose_rate:d explicit_missing_glucose:i gap_count:i max_gap_minutes:d valid_days:i observed_days:i median_interval_minutes:d duplicate_timestamps:i estimated_missing_readings:i")
def missingness_summary(spark, d):
    return missingness.missingness_summary(readings(spark, d), MINUTES)


IMPUTED = f"""{SNAP}, md AS (SELECT id, CASE WHEN missing_glucose = 0 THEN 'none' WHEN missing_glucose_rate <= 5 THEN 'arima' ELSE 'xgboost' END AS imputation_model FROM gs),
o AS (SELECT *, hour(timestamp) AS hour, last(CASE WHEN glucose IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS s0, last(glucose IGNORE NULLS) OVER b AS g0, first(CASE WHEN glucose IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS s1, first(glucose IGNORE NULLS) OVER a AS g1 FROM e
 WINDOW b AS (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
us_ AS (SELECT id, hour, avg(glucose) AS at_hour FROM o WHERE glucose IS NOT NULL GROUP BY id, hour), ov AS (SELECT id, avg(glucose) AS overall FROM e GROUP BY id),
im AS (SELECT o.id, o.timestamp, imputation_model, CASE WHEN inserted THEN 'timestamp_gap' WHEN explicit THEN 'explicit_na' ELSE 'observed' END AS missing_source, glucose IS NULL AND g0 IS NOT NULL AND g1 IS NOT NULL AS imputed_flag,
 CASE WHEN glucose IS NOT NULL THEN glucose WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN least(500, greatest(39, g0 + (g1 - g0) * (slot - s0) / (s1 - s0)::DOUBLE
 + CASE WHEN imputation_model = 'xgboost' AND least(slot - s0, s1 - slot) >= 3 THEN 0.5::DOUBLE * coalesce(at_hour - overall, 0) ELSE 0 END)) END AS glucose
 FROM o JOIN md USING (id) JOIN ov USING (id) LEFT JOIN us_ ON us_.id = o.id AND us_.hour = o.hour)"""


@query("missingness_compare", f"""{IMPUTED}, af AS (SELECT id, count(*) AS rows, count_if(glucose IS NULL) AS missing, count_if(imputed_flag AND glucose IS NOT NULL) AS filled FROM im GROUP BY id)
FINAL SELECT id, expanded_rows AS original_expanded_rows, missing_glucose AS original_missing_glucose, missing_glucose_rate AS original_missing_glucose_rate, rows AS analysis_expanded_rows, missing AS analysis_missing_glucose,
 round(100.0::DOUBLE * missing / rows, 2) AS analysis_missing_glucose_rate, filled AS filled_glucose, missing - missing_glucose AS missing_change FROM gs JOIN af USING (id)""",
    "id:s original_expanded_rows:i original_missing_glucose:i original_missing_glucose_rate:d analysis_expanded_rows:i analysis_missing_glucose:i analysis_missing_glucose_rate:d filled_glucose:i missing_change:i")
def missingness_compare(spark, d):
    r = readings(spark, d)
    return missingness.compare(r, imputation.impute(r, minutes=MINUTES), MINUTES)


@query("missingness_review", f"""{SNAP}
FINAL SELECT id, expanded_rows, missing_glucose, missing_glucose_rate, CASE WHEN missing_glucose_rate = 0 THEN 'No missing glucose' WHEN missing_glucose_rate <= 5 THEN 'Acceptable missingness' WHEN missing_glucose_rate <= 25 THEN 'Moderate missingness' ELSE 'Severe missingness' END AS severity, missing_glucose_rate > 25 AS warn FROM gs""",
    "id:s expanded_rows:i missing_glucose:i missing_glucose_rate:d severity:s warn:b")
def missingness_review(spark, d):
    return missingness.missingness_review(readings(spark, d), MINUTES)


SUBJECT = f"WITH {SPARSE}, b AS (SELECT id, \"group\", sex, avg(glucose) AS v FROM g GROUP BY ALL)"


def subject_metrics(spark, d, order=None):
    r = readings(spark, d, dense=False)
    return metrics.base_metrics(r.withColumn("metric_period", F.lit("full_day")), keys=["id", "group", "sex", "metric_period"], order=order)


@query("group_summary", f"""{SUBJECT}
FINAL SELECT "group", count(*) AS n, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(quantile_cont(v, 0.5), 2) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2) AS iqr, round(min(v), 2) AS minimum, round(max(v), 2) AS maximum FROM b WHERE v IS NOT NULL GROUP BY "group" """,
    "group:s n:i mean:d sd:d median:d iqr:d minimum:d maximum:d")
def group_summary(spark, d):
    return stats.group_summary(subject_metrics(spark, d), "mean_glucose")


@query("welch_moments", f"""{SUBJECT}\nFINAL SELECT "group", count(*) AS n, avg(v) AS mean, var_samp(v) AS variance FROM b WHERE v IS NOT NULL GROUP BY "group" """, "group:s n:i mean:d variance:d")
def welch_moments(spark, d):
    return stats.moments(subject_metrics(spark, d), "mean_glucose")


@query("rank_sums", f"""{SUBJECT}, t AS (SELECT v, count(*) AS t FROM b WHERE v IS NOT NULL GROUP BY v), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS mr FROM b WHERE v IS NOT NULL)
FINAL SELECT "group", count(*) AS n, sum(mr) AS rank_sum, (SELECT sum(t * t * t - t) FROM t) AS tie_term FROM r GROUP BY "group" """, "group:s n:i rank_sum:d tie_term:i")  # fmt: skip
def rank_sums(spark, d):
    return stats.rank_sums(subject_metrics(spark, d, "_ord"), "mean_glucose")


@query("welch_test", f"""{SUBJECT}, a AS (SELECT sex, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM b WHERE v IS NOT NULL GROUP BY sex), o AS (SELECT string_agg(sex, ' vs ' ORDER BY sex) AS groups, string_agg(n, ' / ' ORDER BY sex) AS n, arg_min(m, sex) - arg_max(m, sex) AS d, sum(s / n) AS e, sum(pow(s / n, 2) / (n - 1)) AS f FROM a),
t AS (SELECT *, d / sqrt(e) AS t, e * e / f AS df FROM o),
p AS (SELECT *, abs(t) / 4000 AS w, list_sum(list_transform(range(4001), lambda k: CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(k * abs(t) / 4000, 2) / df, -(df + 1) / 2))) AS y FROM t)
FINAL SELECT 'mean_glucose' AS metric, 'sex' AS grouping, 'welch_t' AS test, groups, n, t AS statistic, 1 - 2 * y * w / 3 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS p_value, '' AS note FROM p""",
    "metric:s grouping:s test:s groups:s n:s statistic:d p_value:d note:s")
def welch_test(spark, d):
    return stats.compare_groups(subject_metrics(spark, d), "mean_glucose", "sex")


@query("wilcoxon_test", f"""{SUBJECT}, t AS (SELECT v, count(*) AS t FROM b WHERE v IS NOT NULL GROUP BY v), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS mr FROM b WHERE v IS NOT NULL),
a AS (SELECT "group", count(*) AS n, sum(mr) AS s FROM r GROUP BY "group"), o AS (SELECT string_agg("group", ' vs ' ORDER BY "group") AS groups, string_agg(n, ' / ' ORDER BY "group") AS sizes, arg_min(n, "group") AS n1, arg_max(n, "group") AS n2, arg_min(s, "group") AS s1, (SELECT sum(t * t * t - t) FROM t) AS tie FROM a),
z AS (SELECT *, s1 - n1 * (n1 + 1) / 2.0::DOUBLE AS w, sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1))::DOUBLE)) AS sigma FROM o),
q AS (SELECT *, abs(w - n1 * n2 / 2.0::DOUBLE - 0.5 * sign(w - n1 * n2 / 2.0::DOUBLE)) / sigma AS z FROM z)
FINAL SELECT 'mean_glucose' AS metric, 'group' AS grouping, 'wilcoxon' AS test, groups, sizes AS n, w AS statistic, 1 - 2 / sqrt(2 * pi()) * (z / 4000 / 3) * list_sum(list_transform(range(4001), lambda k: CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k * z / 4000, 2) / 2))) AS p_value, '' AS note FROM q""",
    "metric:s grouping:s test:s groups:s n:s statistic:d p_value:d note:s")
def wilcoxon_test(spark, d):
    return stats.compare_groups(subject_metrics(spark, d, "_ord"), "mean_glucose", "group", "wilcoxon")


@query("shannon_entropy", f"""WITH {DENSE}, lo AS (SELECT id, floor(min(glucose) / 10) * 10 AS low FROM g GROUP BY id),
b AS (SELECT g.id, greatest(ceil((glucose - low) / 10), 1) AS bin, count(*) AS c FROM g JOIN lo USING (id) WHERE glucose IS NOT NULL GROUP BY ALL)
FINAL SELECT id, sum(c) AS readings, CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) ELSE 0 END AS shannon_entropy FROM b GROUP BY id""", "id:s readings:i shannon_entropy:d")  # fmt: skip
def shannon_entropy(spark, d):
    return complexity.shannon(readings(spark, d))


SERIES = f"WITH {DENSE}, v AS (SELECT id, glucose AS x, row_number() OVER (PARTITION BY id ORDER BY timestamp, _ord) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, avg(glucose) OVER (PARTITION BY id) AS mean FROM g WHERE glucose IS NOT NULL)"


@query("dfa", f"""{SERIES}, y AS (SELECT id, i, n, sum(x - mean) OVER (PARTITION BY id ORDER BY i) AS y FROM v),
w AS (SELECT DISTINCT id, n, CAST(floor(exp(ln(8::DOUBLE) + (ln(floor(n / 4.0::DOUBLE)) - ln(8::DOUBLE)) * (k / 7.0::DOUBLE))) AS BIGINT) AS scale FROM (SELECT DISTINCT id, n FROM v), range(8) AS r(k)),
s AS (SELECT y.id, scale, i // scale AS seg, regr_syy(y, i % scale) / count(*) AS vy, regr_sxx(y, i % scale) / count(*) AS vt, regr_sxy(y, i % scale) / count(*) AS cov FROM y JOIN w USING (id) WHERE scale >= 8 AND scale < y.n / 2.0 AND i < (y.n // scale) * scale GROUP BY ALL)
FINAL SELECT id, scale, sqrt(avg(greatest(0, vy - cov * cov / vt))) AS fluctuation FROM s GROUP BY id, scale""", "id:s scale:i fluctuation:d")  # fmt: skip
def dfa(spark, d):
    return complexity.dfa(readings(spark, d))


@query("higuchi", f"""{SERIES}, m AS (SELECT a.id, k, sum(abs(b.x - a.x)) * (max(a.n) - 1) / (count(*) * max(k)) AS l FROM (SELECT *, unnest(range(1, 9)) AS k FROM v) a JOIN v b ON b.id = a.id AND b.i = a.i + a.k GROUP BY a.id, k, a.i % k)
FINAL SELECT id, k AS scale, avg(l) AS curve_length FROM m GROUP BY id, k""", "id:s scale:i curve_length:d")  # fmt: skip
def higuchi(spark, d):
    return complexity.higuchi(readings(spark, d))


ENTROPY = """k AS (SELECT id, i, x FROM v WHERE n <= 1000 UNION SELECT v.id, v.i, v.x FROM v JOIN (SELECT DISTINCT id, n, CAST(floor(j * (n - 1) / 999.0::DOUBLE + 0.5) AS BIGINT) AS i FROM (SELECT DISTINCT id, n FROM v WHERE n > 1000), range(1000) AS r(j)) p ON p.id = v.id AND p.i = v.i),
j AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY id) AS n FROM k),
c AS (SELECT id, scale, j // scale AS c, avg(x) AS y FROM j, range(1, 6) AS r(scale) WHERE j // scale < n // scale GROUP BY ALL),
t AS (SELECT id, scale, c, y, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2, 0.15::DOUBLE * stddev_samp(y) OVER (PARTITION BY id, scale) AS r FROM c WINDOW w AS (PARTITION BY id, scale ORDER BY c)),
h AS (SELECT a.id, a.scale, count(*) AS hits, count_if(abs(a.y2 - b.y2) <= a.r) AS more FROM t a JOIN t b ON a.id = b.id AND a.scale = b.scale AND a.c < b.c AND abs(a.y - b.y) <= a.r AND abs(a.y1 - b.y1) <= a.r WHERE a.y2 IS NOT NULL AND b.y2 IS NOT NULL GROUP BY ALL)"""


@query("multiscale_entropy", f"{SERIES}, {ENTROPY}\nFINAL SELECT id, scale, -ln(more / hits::DOUBLE) AS sample_entropy FROM h WHERE more > 0", "id:s scale:i sample_entropy:d")
def multiscale_entropy(spark, d):
    return complexity.mse(readings(spark, d))


WHOLE_ENTROPY = ENTROPY.replace(ENTROPY[: ENTROPY.index("\nj AS")], "").replace("FROM k)", "FROM v)").lstrip("\n")


@query("multiscale_entropy_whole", f"{SERIES}, {WHOLE_ENTROPY}\nFINAL SELECT id, scale, -ln(more / hits::DOUBLE) AS sample_entropy FROM h WHERE more > 0", "id:s scale:i sample_entropy:d")
def multiscale_entropy_whole(spark, d):
    return complexity.mse(readings(spark, d), ComplexityParams(thin_to=None))


HURST = """q AS (SELECT id, unnest(list_filter([n >> k for k in range(40)], lambda w: w >= 16)) AS scale FROM (SELECT id, max(n) AS n FROM v GROUP BY id HAVING max(x) > min(x))),
sg AS (SELECT v.id, scale, i // scale AS seg, i, x, avg(x) OVER s AS m, stddev_pop(x) OVER s AS sd FROM v JOIN q USING (id) WHERE i < (n // scale) * scale WINDOW s AS (PARTITION BY v.id, scale, i // scale)),
rz AS (SELECT *, sum(x - m) OVER (PARTITION BY id, scale, seg ORDER BY i) AS z FROM sg), rs AS (SELECT id, scale, avg(rs) AS rs FROM (SELECT id, scale, seg, (max(z) - min(z)) / nullif(max(sd), 0) AS rs FROM rz GROUP BY ALL) GROUP BY id, scale),
hu AS (SELECT id, 0.5 + regr_slope(ln(rs) - ln((scale - 0.5) / scale * CASE WHEN scale <= 340 THEN exp(lgamma((scale - 1) / 2.0::DOUBLE) - lgamma(scale / 2.0::DOUBLE)) / sqrt(pi()) ELSE 1 / sqrt(scale * pi() / 2) END
 * list_sum(list_transform(range(1, scale), lambda k: sqrt((scale - k) / k::DOUBLE)))), ln(scale)) AS hurst FROM rs WHERE rs > 0 GROUP BY id)"""


@query("hurst", f"{SERIES}, {HURST}\nFINAL SELECT * FROM hu", "id:s hurst:d")
def hurst(spark, d):
    return complexity.hurst(readings(spark, d))


SCALARS = f"""{SERIES}, {HURST}, lo AS (SELECT id, floor(min(x) / 10) * 10 AS low FROM v GROUP BY id), bn AS (SELECT v.id, greatest(ceil((x - low) / 10), 1) AS bin, count(*) AS c FROM v JOIN lo USING (id) GROUP BY ALL),
se AS (SELECT id, CAST(sum(c) AS BIGINT) AS readings, CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) ELSE 0 END AS shannon_entropy FROM bn GROUP BY id),
y AS (SELECT id, i, n, sum(x - mean) OVER (PARTITION BY id ORDER BY i) AS y FROM v), w AS (SELECT DISTINCT id, n, CAST(floor(exp(ln(8::DOUBLE) + (ln(floor(n / 4.0::DOUBLE)) - ln(8::DOUBLE)) * (k / 7.0::DOUBLE))) AS BIGINT) AS scale FROM (SELECT DISTINCT id, n FROM v), range(8) AS r(k)),
ds AS (SELECT y.id, scale, i // scale AS seg, regr_syy(y, i % scale) / count(*) AS vy, regr_sxx(y, i % scale) / count(*) AS vt, regr_sxy(y, i % scale) / count(*) AS cov FROM y JOIN w USING (id) WHERE scale >= 8 AND scale < y.n / 2.0 AND i < (y.n // scale) * scale GROUP BY ALL),
df AS (SELECT id, scale, sqrt(avg(greatest(0, vy - cov * cov / vt))) AS fluctuation FROM ds GROUP BY id, scale), hm AS (SELECT a.id, k, sum(abs(b.x - a.x)) * (max(a.n) - 1) / (count(*) * max(k)) AS l FROM (SELECT *, unnest(range(1, 9)) AS k FROM v) a JOIN v b ON b.id = a.id AND b.i = a.i + a.k GROUP BY a.id, k, a.i % k),
hg AS (SELECT id, k AS scale, avg(l) AS curve_length FROM hm GROUP BY id, k),
al AS (SELECT id, CASE WHEN count(*) >= 2 THEN regr_slope(ln(fluctuation), ln(scale)) END AS dfa_alpha FROM df WHERE fluctuation > 0 GROUP BY id), fd AS (SELECT id, CASE WHEN count(*) >= 2 THEN regr_slope(ln(curve_length), -ln(scale)) END AS higuchi_fd FROM hg WHERE curve_length > 0 GROUP BY id),
cm AS (SELECT se.id, readings, CASE WHEN readings >= 100 THEN shannon_entropy END AS shannon_entropy, CASE WHEN readings >= 100 THEN hurst END AS hurst, CASE WHEN readings >= 100 THEN dfa_alpha END AS dfa_alpha, CASE WHEN readings >= 100 THEN higuchi_fd END AS higuchi_fd,
 CASE WHEN readings < 100 THEN 'Fewer than 100 readings' ELSE '' END AS note, CASE WHEN readings >= 100 AND hurst IS NULL THEN 'Hurst exponent could not be computed for this series.' ELSE '' END AS hurst_note,
 CASE WHEN readings >= 100 AND dfa_alpha IS NULL THEN 'DFA alpha could not be computed for this series.' ELSE '' END AS dfa_alpha_note, CASE WHEN readings >= 100 AND higuchi_fd IS NULL THEN 'Higuchi fractal dimension could not be computed for this series.' ELSE '' END AS higuchi_fd_note
 FROM se LEFT JOIN hu USING (id) LEFT JOIN al USING (id) LEFT JOIN fd USING (id))"""


@query("complexity_metrics", f"{SCALARS}\nFINAL SELECT *, NULL AS sample_entropy, NULL AS approximate_entropy, NULL AS multiscale_sample_entropy FROM cm",
    "id:s readings:i shannon_entropy:d hurst:d dfa_alpha:d higuchi_fd:d hurst_note:s dfa_alpha_note:s higuchi_fd_note:s sample_entropy:d approximate_entropy:d multiscale_sample_entropy:d note:s")
def complexity_metrics(spark, d):
    return complexity.complexity_metrics(readings(spark, d))


@query("functional_grid", f"""WITH {DENSE}
FINAL SELECT id, CAST(timestamp AS DATE) AS date, CASE WHEN round_even(mod / 5.0::DOUBLE, 0) * 5 >= 1440 THEN 1435 ELSE round_even(mod / 5.0::DOUBLE, 0) * 5 END AS time_minutes, avg(glucose) AS raw_glucose, count(*) AS observed_points, 0 AS imputed_points FROM g WHERE glucose IS NOT NULL GROUP BY 1, 2, 3""",
    "id:s date:D time_minutes:i raw_glucose:d observed_points:i imputed_points:i")
def functional_grid(spark, d):
    return functional.day_grid(readings(spark, d))


RAW_CURVES = f"""WITH {DENSE}, dg AS (SELECT id, CAST(timestamp AS DATE) AS date, least(round_even(mod / 5.0::DOUBLE, 0) * 5, 1435) AS t, avg(glucose) AS x FROM g WHERE glucose IS NOT NULL GROUP BY 1, 2, 3),
sc AS (SELECT id, t, avg(x) AS m, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, count(DISTINCT date) AS days FROM dg GROUP BY id, t)"""


@query("functional_subject_curves", f"{RAW_CURVES}\nFINAL SELECT id, t AS time_minutes, m AS mean_glucose, q25, q75, days FROM sc", "id:s time_minutes:i mean_glucose:d q25:d q75:d days:i")
def functional_subject_curves(spark, d):
    return functional.subject_curves(functional.day_grid(readings(spark, d)), "raw_glucose", None)


@query("functional_curve_features", f"""{RAW_CURVES}
FINAL SELECT id, max(days) AS days, arg_min(t, (-round(m, 9), t)) AS peak_minutes, max(m) AS peak_glucose, arg_min(t, (round(m, 9), t)) AS nadir_minutes, min(m) AS nadir_glucose, 100.0::DOUBLE * count_if(m < 70) / count(*) AS time_below_range_percent,
 100.0::DOUBLE * count_if(m BETWEEN 70 AND 180) / count(*) AS time_in_range_percent, 100.0::DOUBLE * count_if(m > 180) / count(*) AS time_above_range_percent, sum(greatest(0, m - 180)) * (5 / 60.0::DOUBLE) AS area_above, sum(greatest(0, 70 - m)) * (5 / 60.0::DOUBLE) AS area_below,
 regr_slope(m, t / 60.0::DOUBLE) FILTER (t < 360) AS overnight_slope, avg(m) FILTER (t >= 360 AND t < 600) - avg(m) FILTER (t >= 240 AND t < 360) AS morning_rise FROM sc GROUP BY id""",
    "id:s days:i peak_minutes:i peak_glucose:d nadir_minutes:i nadir_glucose:d time_below_range_percent:d time_in_range_percent:d time_above_range_percent:d area_above:d area_below:d overnight_slope:d morning_rise:d")
def functional_curve_features(spark, d):
    return functional.curve_features(functional_subject_curves(spark, d))


@query("functional_day_curves")
def functional_day_curves(spark, d):
    return functional.day_curves(readings(spark, d))


@query("functional_day_curves_fourier")
def functional_day_curves_fourier(spark, d):
    return functional.day_curves(readings(spark, d), FunctionalParams(basis="fourier"))


@query("fpca_incomplete")
def fpca_incomplete(spark, d):
    """Scores of curves as they were read, with whatever slots they lack."""
    return functional.fpca_scores(functional_subject_curves(spark, d))


@query("functional_features")
def functional_features(spark, d):
    return functional.profile_bundle(readings(spark, d))["features"]


@query("fpca_kmeans")
def fpca_kmeans(spark, d):
    days = functional.day_curves(readings(spark, d))
    return functional.phenotypes(functional.fpca_scores(functional.subject_curves(days)))


def _example_sql() -> str:
    m = 60_000_000
    lags = ", ".join(f"CASE WHEN t1{k} = t0{k} THEN g0{k} ELSE g0{k} + (g1{k} - g0{k}) * ((us - {k * m} - t0{k}) / nullif(t1{k} - t0{k}, 0)::DOUBLE) END AS lag_{k}_glucose" for k in (5, 15, 30, 60))
    raw = ", ".join(
        f"last(us) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND {k * m} PRECEDING) AS t0{k}, last(glucose) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND {k * m} PRECEDING) AS g0{k}, "
        f"first(us) OVER (w RANGE BETWEEN {k * m} PRECEDING AND UNBOUNDED FOLLOWING) AS t1{k}, first(glucose) OVER (w RANGE BETWEEN {k * m} PRECEDING AND UNBOUNDED FOLLOWING) AS g1{k}"
        for k in (5, 15, 30, 60)
    )
    win = ", ".join(
        f"avg(glucose) OVER ({s}) AS window_{k}_mean, coalesce(stddev_samp(glucose) OVER ({s}), 0) AS window_{k}_sd, min(glucose) OVER ({s}) AS window_{k}_min, max(glucose) OVER ({s}) AS window_{k}_max, "
        f"(glucose - first(glucose) OVER ({s})) / nullif((us - first(us) OVER ({s})) / 3.6e9::DOUBLE, 0) AS window_{k}_slope"
        for k in (15, 30, 60)
        for s in [f"w RANGE BETWEEN {k * m - 1} PRECEDING AND CURRENT ROW"]
    )
    names = predictive.feature_columns()
    full = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"""WITH {DENSE}, v AS (SELECT id, us, timestamp, glucose, mod FROM g WHERE glucose IS NOT NULL),
r AS (SELECT *, {raw}, {win}, min(glucose) OVER (w RANGE BETWEEN 1 FOLLOWING AND {30 * m} FOLLOWING) AS target_value, count(glucose) OVER (w RANGE BETWEEN 1 FOLLOWING AND {30 * m} FOLLOWING) AS future_points, max(us) OVER (PARTITION BY id) AS fin FROM v WINDOW w AS (PARTITION BY id ORDER BY us)),
l AS (SELECT *, glucose AS glucose_current, {lags}, sin(2 * pi() * mod / 1440) AS time_sin, cos(2 * pi() * mod / 1440) AS time_cos FROM r)
FINAL SELECT *, CASE WHEN target_value < 70 THEN 1 ELSE 0 END AS target FROM l WHERE target_value IS NOT NULL AND us <= fin - {30 * m} AND {full}"""


@query("predictive_examples", _example_sql(), "id:s timestamp:t " + " ".join(f"{c}:d" for c in predictive.feature_columns()) + " future_points:i target_value:d target:i")
def predictive_examples(spark, d):
    return predictive.examples(readings(spark, d)).drop("date", "target_label")


EXAMPLES = ", ex AS (".join(_example_sql().split("\nFINAL ")) + f"""), dy AS (SELECT id, CAST(timestamp AS DATE) AS date, row_number() OVER (PARTITION BY id ORDER BY CAST(timestamp AS DATE) DESC) AS back, count(*) OVER (PARTITION BY id) AS days FROM ex GROUP BY id, CAST(timestamp AS DATE)),
sp AS (SELECT ex.*, dy.date, CASE WHEN CASE WHEN days > 1 THEN back <= greatest(1, ceil(days * 0.3::DOUBLE)) ELSE row_number() OVER (PARTITION BY ex.id ORDER BY timestamp DESC) <= greatest(1, floor(0.3::DOUBLE * count(*) OVER (PARTITION BY ex.id))) END THEN 'test' ELSE 'train' END AS split
 FROM ex JOIN dy ON dy.id = ex.id AND dy.date = CAST(ex.timestamp AS DATE))"""


@query("predictive_split", f"{EXAMPLES}\nFINAL SELECT id, split, count(*) AS n, count(DISTINCT date) AS days, sum(target) AS events, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM sp GROUP BY id, split",
    "id:s split:s n:i days:i events:i first_timestamp:t last_timestamp:t")
def predictive_split(spark, d):
    rows = predictive.training_rows(predictive.examples(readings(spark, d)))
    return rows.groupBy("id", "split").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"), F.sum("target").alias("events"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


PERFORMANCE = f"""{EXAMPLES}, sc AS (SELECT id, target, 1 / (1 + exp((round(glucose_current) - 100) / 20::DOUBLE)) AS p FROM sp WHERE split = 'test'),
rk AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY p) + (count(*) OVER (PARTITION BY id, p) - 1) / 2.0::DOUBLE AS mr FROM sc)
FINAL SELECT id, count(*) AS test_rows, sum(target) AS test_events, (sum(CASE WHEN target = 1 THEN mr END) - sum(target) * (sum(target) + 1) / 2.0::DOUBLE) / nullif(sum(target) * (count(*) - sum(target)), 0) AS auc,
 count_if(target = 1 AND p >= 0.5) / nullif(sum(target), 0)::DOUBLE AS sensitivity, count_if(target = 0 AND p < 0.5) / nullif(count(*) - sum(target), 0)::DOUBLE AS specificity, avg(pow(p - target, 2)) AS brier_score, 0.5 AS threshold FROM rk GROUP BY id"""


@query("predictive_performance", PERFORMANCE,
    "id:s test_rows:i test_events:i auc:d sensitivity:d specificity:d brier_score:d threshold:d")
def predictive_performance(spark, d):
    """Of a given score, so that nothing but the measures is compared."""
    rows = predictive.training_rows(predictive.examples(readings(spark, d)))
    return predictive.performance(rows.withColumn("risk_probability", 1 / (1 + F.exp((F.round("glucose_current") - 100) / 20))), by=("id",))


def given_scores(spark, d):
    """Examples with a given score, so that nothing but what is made of scores is compared."""
    return predictive.training_rows(predictive.examples(readings(spark, d))).withColumn("risk_probability", 1 / (1 + F.exp((F.round("glucose_current") - 100) / 20)))


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower().replace(" ", "_") for c in df.columns))


MODEL_SQL = "'{}' AS model, 'Glucose below 70 mg/dL within 30 minutes' AS target, '30 minutes' AS horizon"


@query("predictive_scores_export", f"""{EXAMPLES}
FINAL SELECT id AS subject_id, timestamp, date, split, glucose_current AS current_glucose, target AS observed_event, target_value AS future_glucose_summary, 1 / (1 + exp((round(glucose_current) - 100) / 20::DOUBLE)) AS risk_probability, {MODEL_SQL.format("Random forest")} FROM sp""",
    "subject_id:s timestamp:t date:D split:s current_glucose:d observed_event:i future_glucose_summary:d risk_probability:d target:s model:s horizon:s")
def predictive_scores_export(spark, d):
    return snake_case(predictive.scores_export(given_scores(spark, d), PredictiveParams(model="random_forest")))


@query("predictive_performance_export", PERFORMANCE.replace("FINAL SELECT id,", ", pf AS (SELECT id,") + f""")
FINAL SELECT id AS subject_id, {MODEL_SQL.format("Logistic regression")}, test_rows, test_events, round(auc, 3) AS auc, round(sensitivity, 3) AS sensitivity, round(specificity, 3) AS specificity, round(brier_score, 3) AS brier_score, threshold FROM pf""",
    "subject_id:s model:s target:s horizon:s test_rows:i test_events:i auc:d sensitivity:d specificity:d brier_score:d threshold:d")
def predictive_performance_export(spark, d):
    return snake_case(predictive.performance_export(predictive.performance(given_scores(spark, d), by=("id",))))


@query("predictive_model")
def predictive_model(spark, d):
    found, _ = predictive.fit_and_score(predictive.examples(readings(spark, d)))
    return predictive.performance(found[0]) if found else spark.createDataFrame([], "test_rows long")


@query("predictive_importance")
def predictive_importance(spark, d):
    found, _ = predictive.fit_and_score(predictive.examples(readings(spark, d)), PredictiveParams(model="random_forest"))
    return found[1] if found else spark.createDataFrame([], "feature string, importance double")


@query("risk_bands", f"""WITH {DENSE}
FINAL SELECT _ord AS event_id, CASE WHEN p >= 0.5 THEN 'high' WHEN p >= 0.25 THEN 'elevated' ELSE 'low' END AS band FROM (SELECT _ord, least(1, glucose / 400) AS p FROM g WHERE glucose IS NOT NULL)""", "event_id:i band:s")  # fmt: skip
def risk_bands(spark, d):
    return readings(spark, d).where("glucose is not null").select(F.col("_ord").alias("event_id"), predictive.risk_band(F.least(F.lit(1.0), F.col("glucose") / 400)).alias("band"))


@query("impute", f"{IMPUTED}\nFINAL SELECT *, CASE imputation_model WHEN 'arima' THEN 'linear' WHEN 'xgboost' THEN 'profile' ELSE 'none' END AS imputation_estimator FROM im",
    "id:s timestamp:t glucose:d imputed_flag:b missing_source:s imputation_model:s imputation_estimator:s")
def impute(spark, d):
    return imputation.impute(readings(spark, d), minutes=MINUTES).select("id", "timestamp", "glucose", "imputed_flag", "missing_source", "imputation_model", "imputation_estimator")


BETWEEN = f"""{SNAP}, o AS (SELECT *, last(CASE WHEN glucose IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS s0, last(glucose IGNORE NULLS) OVER b AS g0, first(CASE WHEN glucose IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS s1, first(glucose IGNORE NULLS) OVER a AS g1 FROM e
 WINDOW b AS (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("impute_linear", f"""{BETWEEN}
FINAL SELECT id, timestamp, CASE WHEN glucose IS NOT NULL THEN glucose WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN least(500, greatest(39, g0 + (g1 - g0) * (slot - s0) / (s1 - s0)::DOUBLE)) END AS glucose, glucose IS NULL AND g0 IS NOT NULL AND g1 IS NOT NULL AS imputed_flag FROM o""",
    "id:s timestamp:t glucose:d imputed_flag:b")
def impute_linear(spark, d):
    return imputation.impute(readings(spark, d), "linear", MINUTES).select("id", "timestamp", "glucose", "imputed_flag")


PER_DAY = 1440 // MINUTES


@query("impute_knn", f"""{BETWEEN}, ds AS (SELECT id, slot // {PER_DAY} AS day, slot % {PER_DAY} AS at, glucose FROM e WHERE glucose IS NOT NULL),
pr AS (SELECT a.id, a.day, b.day AS other, round(sqrt(avg(pow(a.glucose - b.glucose, 2))), 9) AS apart FROM ds a JOIN ds b ON a.id = b.id AND a.at = b.at AND a.day <> b.day AND abs(a.day - b.day) <= 180 GROUP BY a.id, a.day, b.day HAVING count(*) >= {PER_DAY // 12}),
nn AS (SELECT e.id, e.slot, ds.glucose, row_number() OVER (PARTITION BY e.id, e.slot ORDER BY apart, other) AS rk FROM e JOIN pr ON pr.id = e.id AND pr.day = e.slot // {PER_DAY} JOIN ds ON ds.id = e.id AND ds.day = pr.other AND ds.at = e.slot % {PER_DAY} WHERE e.glucose IS NULL),
kn AS (SELECT id, slot, avg(glucose) AS estimate FROM nn WHERE rk <= 7 GROUP BY id, slot)
FINAL SELECT o.id, o.timestamp, CASE WHEN glucose IS NOT NULL THEN glucose WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN least(500, greatest(39, coalesce(estimate, g0 + (g1 - g0) * (o.slot - s0) / (s1 - s0)::DOUBLE))) END AS glucose, glucose IS NULL AND g0 IS NOT NULL AND g1 IS NOT NULL AS imputed_flag
 FROM o LEFT JOIN kn ON kn.id = o.id AND kn.slot = o.slot""", "id:s timestamp:t glucose:d imputed_flag:b")  # fmt: skip
def impute_knn(spark, d):
    return imputation.impute(readings(spark, d), "knn", MINUTES).select("id", "timestamp", "glucose", "imputed_flag")


@query("impute_kalman")
def impute_kalman(spark, d):
    """Tested against the joint normal distribution of a whole series."""
    return imputation.impute(readings(spark, d), "kalman", MINUTES).select("id", "timestamp", "glucose", "imputed_flag", "imputation_estimator", "imputation_error")


@query("lttb", f"""WITH RECURSIVE {DENSE}, v AS (SELECT id, timestamp, us, glucose, row_number() OVER (PARTITION BY id ORDER BY timestamp, _ord) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM g WHERE glucose IS NOT NULL),
ed AS (SELECT id, n, b, CAST(floor(b * ((n - 2) / 248.0::DOUBLE)) AS BIGINT) + 1 AS a FROM (SELECT DISTINCT id, n FROM v WHERE n > 250), range(249) AS r(b)),
bk AS (SELECT id, n, b, a, least(lead(a) OVER w, n - 1) AS z, coalesce(lead(a, 2) OVER w, n) AS c FROM ed WINDOW w AS (PARTITION BY id ORDER BY b)),
bm AS (SELECT bk.id, bk.b, bk.a, bk.z, avg(v.us) AS mx, avg(v.glucose) AS my FROM bk JOIN v ON v.id = bk.id AND v.i >= bk.z AND v.i < bk.c WHERE bk.z IS NOT NULL GROUP BY ALL),
kept AS (SELECT id, CAST(-1 AS BIGINT) AS b, i, CAST(us AS DOUBLE) AS px, glucose AS py FROM v WHERE i = 0 AND n > 250
 UNION ALL SELECT id, b, best.i, best.x, best.y FROM (SELECT k.id, bm.b, arg_max({{'i': v.i, 'x': CAST(v.us AS DOUBLE), 'y': v.glucose}}, (abs((k.px - bm.mx) * (v.glucose - k.py) - (k.px - v.us) * (bm.my - k.py)) / 2, -v.i)) AS best
  FROM kept k JOIN bm ON bm.id = k.id AND bm.b = k.b + 1 JOIN v ON v.id = k.id AND v.i >= bm.a AND v.i < bm.z GROUP BY k.id, bm.b)),
al AS (SELECT id, i FROM kept UNION SELECT id, i FROM v WHERE n <= 250 OR i = n - 1 UNION SELECT id, arg_min(i, (glucose, i)) FROM v GROUP BY id UNION SELECT id, arg_max(i, (glucose, -i)) FROM v GROUP BY id)
FINAL SELECT v.id, timestamp, glucose, false AS imputed_flag FROM v JOIN al ON al.id = v.id AND al.i = v.i""", "id:s timestamp:t glucose:d imputed_flag:b")  # fmt: skip
def lttb(spark, d):
    return downsample.lttb(readings(spark, d), 250)


@query("timestamp_parse", f"""WITH {TEXT}
FINAL SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts) END AS timestamp FROM x""", "event_id:i timestamp:t")  # fmt: skip
def timestamp_parse(spark, d):
    return text_readings(spark, d).select("event_id", std.parse_timestamp(F.col("timestamp_text")).alias("timestamp"))


@query("glucose_parse", f"WITH {TEXT}\nFINAL SELECT event_id, try_cast(replace(glucose_text, ',', '') AS DOUBLE) AS mg_dl, try_cast(replace(glucose_text, ',', '') AS DOUBLE) * 18.0182::DOUBLE AS from_mmol FROM x", "event_id:i mg_dl:d from_mmol:d")
def glucose_parse(spark, d):
    g = std.coerce_glucose(F.col("glucose_text"))
    return text_readings(spark, d).select("event_id", std.to_mg_dl(g).alias("mg_dl"), std.to_mg_dl(g, "mmol/L").alias("from_mmol"))


@query("ambiguous_timestamps", f"""WITH {TEXT}
FINAL SELECT event_id, event_id % 5 = 2 AND day(ts) <= 12 AND day(ts) <> month(ts) AS ambiguous, event_id % 5 = 3 AS date_only FROM x""", "event_id:i ambiguous:b date_only:b")  # fmt: skip
def ambiguous_timestamps(spark, d):
    return text_readings(spark, d).select("event_id", std.is_ambiguous(F.col("timestamp_text")).alias("ambiguous"), std.is_date_only(F.col("timestamp_text")).alias("date_only"))


@query("timestamp_parse_summary", f"""WITH {TEXT}, n AS (SELECT count(*) AS rows FROM x), s AS (SELECT *, event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts) END AS t FROM x ORDER BY event_id LIMIT 5000)
FINAL SELECT count(*) AS sampled_rows, count(timestamp_text) AS non_missing, count(t) AS parsed, count(*) - count(t) AS failed, count_if(k = 2 AND day(ts) <= 12 AND day(ts) <> month(ts)) AS ambiguous, count_if(k = 3) AS date_only,
 min(t) AS first_timestamp, max(t) AS last_timestamp, (SELECT rows FROM n) AS rows FROM s""", "sampled_rows:i non_missing:i parsed:i failed:i ambiguous:i date_only:i first_timestamp:t last_timestamp:t rows:i")  # fmt: skip
def timestamp_parse_summary(spark, d):
    return std.parse_summary(text_readings(spark, d), "timestamp_text")


@query("standardize", f"WITH {SPARSE}\nFINAL SELECT id, id_source, timestamp, glucose, 'mg/dL' AS units, \"group\", sex FROM g", "id:s id_source:s timestamp:t glucose:d units:s group:s sex:s")
def standardize(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.when(F.col("event_type") != "error", (40 + F.col("value")).cast("string")).alias("value"), F.col("event_id").alias("_ord"))
    meta = e.select(F.concat(F.lit(" U"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 2 == 0, "Control").otherwise("Treatment").alias("group"), F.when(F.col("user_id") % 3 == 0, "F").otherwise("M").alias("sex"), F.lit(" ").alias("empty")).distinct()
    return std.standardize(raw, {"id": "subject", "timestamp": "time", "glucose": "value"}, metadata=meta, check=False).select("id", "id_source", "timestamp", "glucose", "units", "group", "sex")


@query("metadata_join", f"{SUBJECT}\nFINAL SELECT * FROM b", "id:s group:s sex:s v:d")
def metadata_join(spark, d):
    r = readings(spark, d, dense=False)
    return metrics.attach_metadata(r.groupBy("id").agg(F.avg("glucose").alias("v")), r, ["group", "sex"])


@query("plot_manifest", f"""WITH {DENSE}
FINAL SELECT id, plot_type, 'cgm-' || plot_type || '-' || lower(id) || '.png' AS file_name FROM (SELECT DISTINCT id FROM g), (VALUES ('trace'), ('daily-overlay'), ('agp'), ('time-in-range')) AS t(plot_type)""", "id:s plot_type:s file_name:s")  # fmt: skip
def plot_manifest(spark, d):
    return export.plot_manifest(readings(spark, d))


@query("export_analysis", f"WITH {SPARSE}\nFINAL SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, glucose FROM g", "id:s timestamp:s glucose:d")
def export_analysis(spark, d):
    return export.analysis_data(readings(spark, d, dense=False)).select("id", "timestamp", "glucose")


@query("complexity_export", f"""{SCALARS}, {ENTROPY}, cv AS (SELECT id, 'DFA' AS metric, scale, fluctuation AS value FROM df WHERE fluctuation > 0 UNION ALL SELECT id, 'Higuchi', scale, curve_length FROM hg WHERE curve_length > 0 UNION ALL SELECT id, 'Multiscale entropy', scale, -ln(more / hits::DOUBLE) FROM h WHERE more > 0)
FINAL SELECT id, 'scalar' AS row_type, unnest(['shannon_entropy', 'hurst', 'dfa_alpha', 'higuchi_fd']) AS metric, NULL AS scale_value, unnest([shannon_entropy, hurst, dfa_alpha, higuchi_fd]) AS value, unnest([note, note || hurst_note, note || dfa_alpha_note, note || higuchi_fd_note]) AS note, 'Observed readings in time order' AS time_basis FROM cm
 UNION ALL SELECT id, 'curve', metric, scale, value, '', 'Observed readings in time order' FROM cv""", "id:s row_type:s metric:s scale_value:d value:d note:s time_basis:s")  # fmt: skip
def complexity_export(spark, d):
    return export.complete_complexity(readings(spark, d))


@query("predictive_per_subject")
def predictive_per_subject(spark, d):
    return predictive.performance(predictive.per_subject_scores(predictive.examples(readings(spark, d))), by=("id",))


@query("predictive_per_subject_forest")
def predictive_per_subject_forest(spark, d):
    """Performance of a forest for each subject, as the exports give it; the forests themselves are tested against trees grown node by node."""
    _, performance, _ = export.complete_predictive(predictive.examples(readings(spark, d)), PredictiveParams(model="random_forest"))
    return snake_case(performance)


@query("complexity_series", f"""WITH {DENSE}, v AS (SELECT id, us, (us - lag(us) OVER (PARTITION BY id ORDER BY us, _ord)) / 6e7::DOUBLE AS gap FROM g WHERE glucose IS NOT NULL),
md AS (SELECT id, quantile_cont(gap, 0.5) AS interval_minutes FROM v WHERE gap > 0 GROUP BY id),
gc AS (SELECT v.id, any_value(interval_minutes) AS interval_minutes, count_if(gap > 1.5 * interval_minutes) AS gap_count FROM v JOIN md USING (id) GROUP BY v.id)
FINAL SELECT g.id, 'observed' AS series_mode, count(*) AS readings, count(glucose) AS usable_points, any_value(gc.interval_minutes) AS interval_minutes, any_value(gc.gap_count) AS gap_count, count(glucose) >= 100 AS eligible,
 CASE WHEN count(glucose) >= 100 THEN 'Eligible. ' ELSE 'Needs at least 100 usable observed points. ' END || 'Using observed finite glucose readings in timestamp order; no interpolation or gap filling was applied.' AS note FROM g LEFT JOIN gc ON gc.id = g.id GROUP BY g.id""",
    "id:s series_mode:s readings:i usable_points:i interval_minutes:d gap_count:i eligible:b note:s")
def complexity_series(spark, d):
    return complexity.series_summary(readings(spark, d)).select("id", "series_mode", "readings", "usable_points", "interval_minutes", "gap_count", "eligible", "note")


@query("upload_summary", f"""WITH {DENSE}, o AS (SELECT count(*) AS n, count(DISTINCT id) AS subjects, CAST(min(timestamp) AS DATE) AS a, CAST(max(timestamp) AS DATE) AS b FROM g)
FINAL SELECT position, ['Files', 'Rows', 'Subjects', 'Date span'][position + 1] AS label, ['1', format('{{:,}}', n), format('{{:,}}', subjects), a || ' to ' || b][position + 1] AS value FROM o, range(4) AS r(position)""", "position:i label:s value:s")  # fmt: skip
def upload_summary(spark, d):
    return review.upload_summary(readings(spark, d))


@query("validation_rows", f"""WITH {TEXT}, t AS (SELECT count_if(k = 4) AS failed, count_if(k <> 4) AS parsed, count_if(k = 2 AND day(ts) <= 12 AND day(ts) <> month(ts)) AS ambiguous, count_if(k = 3) AS date_only FROM (SELECT *, event_id % 5 AS k FROM x ORDER BY event_id LIMIT 5000)),
n AS (SELECT try_cast(replace(glucose_text, ',', '') AS DOUBLE) AS v FROM x), u AS (SELECT count(v) AS numeric, count(*) - count(v) AS odd, count_if(v < 40 OR v > 400) AS implausible, quantile_cont(v, 0.5) < 25 AS suspicious FROM n)
FINAL SELECT position, ['Timestamps parse', 'Date order', 'Times of day', 'Glucose is numeric', 'Glucose is plausible', 'Units'][position + 1] AS check,
 CASE WHEN [parsed > 0 AND failed = 0, ambiguous = 0, date_only = 0, numeric > 0 AND odd = 0, implausible = 0, NOT suspicious][position + 1] THEN 'Ready' ELSE 'Needs attention' END AS status,
 [format('{{:,}}', failed) || ' invalid timestamp(s)', format('{{:,}}', ambiguous) || ' ambiguous date value(s)', format('{{:,}}', date_only) || ' value(s) without a time', format('{{:,}}', odd) || ' non-numeric value(s)',
  format('{{:,}}', implausible) || ' value(s) outside review range', CASE WHEN suspicious THEN 'Values don''t look like the chosen units' ELSE '' END][position + 1] AS detail FROM t, u, range(6) AS r(position)""",
    "position:i check:s status:s detail:s")
def validation_rows(spark, d):
    t = text_readings(spark, d)
    return review.validation(std.parse_summary(t, "timestamp_text"), std.glucose_summary(t, "glucose_text"))


@query("glucose_parse_summary", f"""WITH {TEXT}, n AS (SELECT glucose_text, try_cast(replace(glucose_text, ',', '') AS DOUBLE) AS v FROM x)
FINAL SELECT count(*) AS rows, count_if(glucose_text <> '') AS non_missing, count(v) AS numeric, count_if(glucose_text = '') AS missing, count_if(v IS NULL) AS non_numeric, min(v) AS min_glucose, max(v) AS max_glucose,
 count_if(v < 40 OR v > 400) AS implausible, quantile_cont(v, 0.5) < 25 AS suspicious_units FROM n""", "rows:i non_missing:i numeric:i missing:i non_numeric:i min_glucose:d max_glucose:d implausible:i suspicious_units:b")  # fmt: skip
def glucose_parse_summary(spark, d):
    return std.glucose_summary(text_readings(spark, d), "glucose_text")


@query("overlay_days", f"WITH {DENSE}\nFINAL SELECT id, count(*) AS readings, count(DISTINCT CAST(timestamp AS DATE)) AS days, count(DISTINCT CAST(timestamp AS DATE)) <= 14 AS show_legend FROM g GROUP BY id", "id:s readings:i days:i show_legend:b")
def overlay_days(spark, d):
    return review.overlay_days(readings(spark, d))


@query("regularized_series", f"""{SNAP}, u AS (SELECT id, anchor, CAST(round_even((us - anchor) / {MINUTES * 60_000_000}.0::DOUBLE, 0) AS BIGINT) AS slot, avg(glucose) AS glucose FROM (SELECT *, min(us) OVER (PARTITION BY id) AS anchor FROM g WHERE glucose IS NOT NULL) GROUP BY ALL),
nb AS (SELECT *, lag(slot) OVER w AS s0, lag(glucose) OVER w AS g0 FROM u WINDOW w AS (PARTITION BY id ORDER BY slot)),
mk AS (SELECT id, anchor, unnest(range(s0 + 1, slot)) AS k, s0, slot, g0, glucose FROM nb WHERE slot - s0 BETWEEN 2 AND 4)
FINAL SELECT id, make_timestamp(anchor + slot * {MINUTES * 60_000_000}) AS timestamp, glucose, false AS interpolated FROM u UNION ALL SELECT id, make_timestamp(anchor + k * {MINUTES * 60_000_000}), g0 + (glucose - g0) * (k - s0) / (slot - s0)::DOUBLE, true FROM mk""",
    "id:s timestamp:t glucose:d interpolated:b")
def regularized_series(spark, d):
    return review.regularize_series(readings(spark, d), MINUTES)


@query("thin_evenly", f"""WITH {DENSE}, v AS (SELECT id, timestamp, glucose, row_number() OVER (PARTITION BY id ORDER BY timestamp, _ord) - 1 AS i, greatest(count(*) OVER (PARTITION BY id) - 1, 1) AS m FROM g)
FINAL SELECT id, timestamp, glucose FROM v WHERE m < 250 OR i = 0 OR floor(i * 249 / m::DOUBLE) > floor((i - 1) * 249 / m::DOUBLE)""", "id:s timestamp:t glucose:d")  # fmt: skip
def thin_evenly(spark, d):
    return downsample.thin_evenly(readings(spark, d), 250).select("id", "timestamp", "glucose")


@query("duplicate_note", f"""{QC}
FINAL SELECT CAST(sum(duplicate_timestamps) AS BIGINT) AS duplicate_timestamps, count_if(duplicate_timestamps > 0) AS affected_subjects,
 format('{{:,}}', CAST(sum(duplicate_timestamps) AS BIGINT)) || ' duplicate timestamp(s) detected across ' || format('{{:,}}', count_if(duplicate_timestamps > 0)) || ' Subject ID(s). Review duplicate timestamps before final analysis if they are unexpected.' AS message
 FROM q HAVING sum(duplicate_timestamps) > 0""", "duplicate_timestamps:i affected_subjects:i message:s")  # fmt: skip
def duplicate_note(spark, d):
    return quality.duplicate_note(quality.qc_summary(readings(spark, d)))


@query("functional_export")
def functional_export(spark, d):
    """Features of all subjects as they are exported; the curves have a query of their own."""
    return export.complete_functional(readings(spark, d))[0]


@query("qc_cards", f"""{QC}
FINAL SELECT count(*) AS subjects, sum(readings) AS readings, sum(missing_glucose) AS missing_glucose, avg(wear_time_percent) AS mean_wear_time_percent, count_if(wear_time_percent < 80) AS low_coverage_subjects, sum(gap_count) AS gap_count, sum(implausible_values) AS implausible_values FROM q""",
    "subjects:i readings:i missing_glucose:i mean_wear_time_percent:d low_coverage_subjects:i gap_count:i implausible_values:i")
def qc_cards(spark, d):
    return quality.qc_cards(quality.qc_summary(readings(spark, d)))


@query("imputation_status", f"""{IMPUTED}, af AS (SELECT id, count_if(imputed_flag AND glucose IS NOT NULL) AS filled, count_if(glucose IS NULL) AS missing_after, max(imputation_model) AS imputation_model FROM im GROUP BY id)
FINAL SELECT gs.id, missing_glucose AS missing_before, filled, missing_after, imputation_model, CASE WHEN missing_glucose = 0 THEN 'No missing glucose' WHEN missing_after = 0 THEN 'Complete' WHEN filled > 0 THEN 'Partly filled' ELSE 'Nothing filled' END AS status
 FROM gs JOIN af USING (id)""", "id:s missing_before:i filled:i missing_after:i imputation_model:s status:s")  # fmt: skip
def imputation_status(spark, d):
    r = readings(spark, d)
    return imputation.status(r, imputation.impute(r, minutes=MINUTES), MINUTES)

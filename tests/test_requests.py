"""Stored results by signature, their states, and the log of times."""

import pytest
from pyspark.sql import functions as F

from glucolake.config import PredictiveParams
from glucolake.operators import requests as Q


def table(spark, rows=((1, 2.5, "a"), (2, None, "b"), (2, None, "b"))):
    return spark.createDataFrame(list(rows), "k int, v double, t string")


def test_signature_depends_on_content_alone(spark):
    df = table(spark)
    same = Q.content_signature(df, {"a": 1})
    assert same == Q.content_signature(df.orderBy(F.desc("k")).repartition(3).select("t", "v", "k"), {"a": 1})
    others = [table(spark, [(1, 2.5, "a"), (2, None, "b")]), table(spark, [(1, 2.5, "a"), (2, 0.0, "b"), (2, None, "b")]), df.withColumn("k", F.col("k").cast("long")), df.withColumnRenamed("t", "u"), df.where("false"), table(spark, [(1, 2.5, "a"), (1, 2.5, "a"), (2, None, "b")])]
    found = {Q.content_signature(d, {"a": 1}) for d in others} | {Q.content_signature(df, {"a": 2}), Q.content_signature(df)}
    assert len(found) == len(others) + 2 and same not in found
    assert Q.content_signature(df, PredictiveParams()) != Q.content_signature(df, PredictiveParams(trees=3))


def test_unchanged_input_reads_the_stored_table(spark, tmp_path):
    requests, calls = Q.Requests(spark, f"file://{tmp_path}"), []

    def make(df):
        calls.append(1)
        return df.withColumn("filled", F.coalesce("v", F.lit(0.0)))

    df = table(spark)
    assert requests.state("impute", df)[0] == "not_run" and requests.result("impute", df) is None
    first, state, message = requests.run("impute", df, None, make)
    assert state == "complete" and message == Q.MESSAGES["complete"] and len(calls) == 1
    again, state, _ = requests.run("impute", df.repartition(4), None, make)
    assert state == "complete" and len(calls) == 1 and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    changed = table(spark, [(1, 2.5, "a"), (2, None, "b"), (2, None, "c")])
    assert requests.state("impute", changed)[0] == "stale" and requests.state("impute", df, {"model": "knn"})[0] == "stale" and requests.state("other", df)[0] == "not_run"
    assert requests.run("impute", changed, None, make)[1] == "complete" and len(calls) == 2 and requests.state("impute", df)[0] == "complete"


def test_failure_gives_the_table_as_it_is(spark, tmp_path):
    requests, df = Q.Requests(spark, f"file://{tmp_path}"), table(spark)
    got, state, message = requests.run("impute", df, None, lambda d: d.select(F.raise_error(F.lit("no model")).cast("double").alias("v")))
    assert state == "failed" and got is df and message.startswith(Q.MESSAGES["failed"] + " Details: ")
    assert requests.state("impute", df)[0] == "failed" and requests.result("impute", df) is None
    assert requests.run("impute", df, None, lambda d: d)[1] == "complete" and requests.state("impute", df)[0] == "complete"


def test_half_written_results_do_not_count(spark, tmp_path):
    requests, df = Q.Requests(spark, f"file://{tmp_path}"), table(spark)
    signature = Q.content_signature(df)
    df.write.parquet(f"file://{tmp_path}/impute/{signature}-lost")
    assert requests.state("impute", df)[0] == "not_run"
    requests._mark("impute", signature, "running", "")
    assert requests.state("impute", df)[0] == "running"


def test_log_counts_rows_as_they_pass(spark, tmp_path):
    log, df = Q.PerformanceLog(spark, str(tmp_path / "log"), "run-1"), table(spark)
    log.timed("write", df, lambda d: d.write.parquet(str(tmp_path / "out")), {"method": "none"})
    assert log.timed("collect", df, lambda d: len(d.collect())) == 3
    with pytest.raises(Exception, match="stop here"):
        log.timed("fails", df, lambda d: d.select(F.raise_error(F.lit("stop here"))).collect())
    rows = {r["label"]: r for r in log.read().collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert (rows["write"]["rows"], rows["write"]["status"], rows["write"]["context"], rows["collect"]["rows"]) == (3, "ok", "method=none", 3)
    assert rows["fails"]["status"] == "error" and rows["fails"]["rows"] is None and "error_message=" in rows["fails"]["context"]
    assert all(r["run_id"] == "run-1" and r["elapsed_seconds"] == pytest.approx(r["elapsed_ms"] / 1000, abs=1e-5) and r["timestamp"] == r["end_time"] for r in rows.values())

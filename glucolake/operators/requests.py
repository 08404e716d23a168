"""Stored results of requests, and a log of how long they took.

A request is a name, a table and parameters.  Its signature depends on the table's columns and
rows, not on their order, and on the parameters.  A result is written to a path of its own and
counts once a small file that names the path has been created, which is one step of the file
system: what a lost driver leaves behind is never read.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What is told of each state.
MESSAGES = {
    "not_run": "Imputation has not been run for the current dataset. Analysis tabs are using non-imputed data.",
    "running": "Imputation is running. Analysis tabs continue to use non-imputed data until it completes.",
    "complete": "Imputation is complete. Analysis tabs are using the imputed dataset.",
    "stale": "Imputation settings or analysis data changed. Run imputation again to refresh imputed analysis data.",
    "failed": "Imputation failed. Analysis tabs are using non-imputed data.",
}


def status_message(state: str, details: str = "") -> str:
    base = MESSAGES.get(state, MESSAGES["not_run"])
    return f"{base} Details: {details}" if details else base


def content_signature(df: DataFrame, parameters: Any = None) -> str:
    """A digest of a table's columns and rows, in any order, and of parameters (a dataclass or what JSON can say)."""
    columns = sorted(df.columns)
    cells = [F.col(f"`{c}`") for c in columns]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit("again"), *cells)
    row = df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(two), F.sum(two.cast("decimal(38,0)"))).first()
    parameters = dataclasses.asdict(parameters) if dataclasses.is_dataclass(parameters) else parameters
    said = json.dumps([[(c, df.schema[c].dataType.simpleString()) for c in columns], [str(x) for x in row], parameters], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


class Requests:
    """Results of requests below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str, signature: str, state: str):
        return self.path(f"{self.folder}/{name}/{signature}.{state}")

    def _mark(self, name: str, signature: str, state: str, said: str) -> None:
        """Create a state's file, whole; one that is there stays."""
        path = self._file(name, signature, state)
        if self.fs.exists(path):
            return
        draft = self.path(f"{self.folder}/{name}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(said.encode()))
        out.close()
        self.fs.rename(draft, path)

    def _said(self, name: str, signature: str, state: str) -> str | None:
        path = self._file(name, signature, state)
        if not self.fs.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path.toString()).collect())

    def _others(self, name: str) -> bool:
        folder = self.path(f"{self.folder}/{name}")
        return self.fs.exists(folder) and any(f.getPath().getName().endswith(".complete") for f in self.fs.listStatus(folder))

    def state(self, name: str, df: DataFrame, parameters: Any = None) -> tuple[str, str]:
        """State of a request and what to tell: ``complete``, ``running``, ``failed``, ``stale`` (another table or other parameters have a result) or ``not_run``."""
        return self._state(name, content_signature(df, parameters))

    def _state(self, name: str, signature: str) -> tuple[str, str]:
        if self._said(name, signature, "complete") is not None:
            return "complete", status_message("complete")
        if self.fs.exists(self._file(name, signature, "running")):
            return "running", status_message("running")
        if (why := self._said(name, signature, "failed")) is not None:
            return "failed", status_message("failed", why)
        state = "stale" if self._others(name) else "not_run"
        return state, status_message(state)

    def result(self, name: str, df: DataFrame, parameters: Any = None) -> DataFrame | None:
        """The stored result of just this table and these parameters."""
        path = self._said(name, content_signature(df, parameters), "complete")
        return None if path is None else self.spark.read.parquet(path)

    def run(self, name: str, df: DataFrame, parameters: Any, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str, str]:
        """The stored result, or that of ``make``, which is stored, or the table as it is where that fails; state and message.

        A failure is stored as well, and tried again by the next call.
        """
        signature = content_signature(df, parameters)
        if (path := self._said(name, signature, "complete")) is not None:
            return self.spark.read.parquet(path), "complete", status_message("complete")
        self.fs.delete(self._file(name, signature, "failed"), False)
        self._mark(name, signature, "running", "")
        path = f"{self.folder}/{name}/{signature}-{uuid.uuid4().hex}"
        try:
            make(df).write.parquet(path)
            self._mark(name, signature, "complete", path)
        except Exception as error:  # whatever it was, the request has failed, and is told to have
            why = str(error).splitlines()[0] if str(error) else type(error).__name__
            self._mark(name, signature, "failed", why)
            return df, "failed", status_message("failed", why)
        finally:
            self.fs.delete(self._file(name, signature, "running"), False)
        return self.spark.read.parquet(self._said(name, signature, "complete")), "complete", status_message("complete")


class PerformanceLog:
    """Times of actions, a row each, appended to CSV files of a folder."""

    SCHEMA = "run_id string, start_time string, end_time string, timestamp string, label string, elapsed_ms double, elapsed_seconds double, rows long, status string, context string"

    def __init__(self, spark: SparkSession, folder: str, run_id: str | None = None):
        self.spark, self.folder = spark, folder
        self.run_id = run_id or dt.datetime.now().strftime("%Y%m%d-%H%M%S")

    def timed(self, label: str, df: DataFrame, action: Callable[[DataFrame], Any], context: dict[str, Any] | None = None) -> Any:
        """What ``action`` returns, a function of the table that reads or writes all of it; its rows are counted as they pass, by no job of their own.

        A failure is logged with its message and raised again.
        """
        seen = Observation()
        began, start = dt.datetime.now(), time.perf_counter()
        status, context = "ok", dict(context or {})
        try:
            return action(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        except Exception as error:
            status, context["error_message"] = "error", str(error).splitlines()[0] if str(error) else type(error).__name__
            raise
        finally:
            seconds = time.perf_counter() - start
            self._add(label, began, seconds, seen.get["rows"] if status == "ok" else None, status, context)

    def _add(self, label: str, began: dt.datetime, seconds: float, rows: int | None, status: str, context: dict[str, Any]) -> None:
        text = lambda t: t.strftime("%Y-%m-%d %H:%M:%S")
        ended = began + dt.timedelta(seconds=seconds)
        said = ";".join(f"{k}={v}" for k, v in context.items() if v is not None)
        row = (self.run_id, text(began), text(ended), text(ended), label, round(1000 * seconds, 3), round(seconds, 6), rows, status, said)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("header", True).csv(self.folder)

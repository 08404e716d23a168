"""Helpers that the operators share: the shared folder, tables written there, Arrow batches.

Executors may be lost at any time, so lineage is cut with tables written into the folder
that the cluster names in ``spark.checkpoint.dir`` (never ``localCheckpoint``).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a worker; Spark's own bound is a number of rows, however long these are.
BATCH_BYTES = "4m"
#: Bytes of text that one step of an Arrow function works on at a time.
STEP_BYTES = 1 << 20

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and the driver is the only machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which can be deleted as a whole once its results are written."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: later readers don't recompute it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote into the shared folder.  Results that were not yet written are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def batched(df: DataFrame) -> DataFrame:
    """``df`` to be handed to Arrow functions in batches of about ``BATCH_BYTES``, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def steps(batch: pa.RecordBatch, column: int | str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose string ``column`` holds about ``limit`` bytes each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 16)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def texts_of(array: pa.Array) -> list[bytes]:
    """UTF-8 of each value, null as empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Shared scratch tables: lineage is cut with Parquet files that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Documents in one batch of the Parquet reader and in one Arrow batch: what a task holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (a local one only where that is unset, as in tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/glyphmill-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to a scratch table and read again, so lost executors recompute nothing behind it.

    The table goes with drop(), or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind df; call when no lazy plan reads it any more."""
    fs, where = _file_system(df.sparkSession, df._scratch)
    fs.delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts stay small, in the JVM and in Python; a lower setting of the user's stays."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":  # the default
        spark.conf.set(key, str(BATCH_BYTES))


def sized(df: DataFrame, n_bytes: int) -> DataFrame:
    """df with a broadcast hint if its measured size allows one."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, with underscores before it where it is taken."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a scan of fewer splits than there are cores is dealt to all of them, never to fewer than it has."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if splits(df) < cores else df


def splits(df: DataFrame) -> int:
    """How many partitions a scan has, as the plan knows them; no file is listed on the driver's Python side."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()

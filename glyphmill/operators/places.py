"""Gapless row numbers of a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, *order: Column | str, name: str = "place") -> DataFrame:
    """df with name = 0, 1, ... in the order of bucket, then order.

    bucket must not decrease along the wanted order; a task numbers one bucket, and only the
    buckets' row counts meet in one place.
    """
    part = df.withColumn("_bucket", bucket)
    counts = part.groupBy(F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    placed = part.withColumn(name, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)).cast("long") - 1)
    joined = placed.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, F.col(name) + F.col("_start")).drop("_bucket", "_b", "_start")

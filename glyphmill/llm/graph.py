"""Connected components by alternating stars, each step a join, its result cut to a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v: long) -> (u, root): the smallest node that each u reaches, for all u above their root.

    Nodes that are their own root have no row. Self-loops, repeated edges, nulls and an empty
    table are fine. Each step takes minima with map-side aggregation, so a hub of any degree
    is never gathered in one task; steps are logarithmic in practice.
    """
    now = _io.cut(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = _io.cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        after = _io.cut(small)
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        _io.drop(large)
        _io.drop(now)
        now = after
        if state == seen:
            return now.withColumnRenamed("v", "root")
        seen = state

"""Connected components by alternating star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.llm.scratch import Scratch


def _mins(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each u, itself included; a partial aggregate, so a hub is no hot group."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` of any orderable type to ``(u, root)``: every node of an edge with its component's smallest node.

    Each round hangs larger neighbours on the smallest (large star), then
    smaller ones (small star); rounds grow with the logarithm of a
    component's diameter.  Only a row count and a checksum reach the driver.
    No edge, or only loops and nulls: no row.
    """
    current = scratch.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_mins(large), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        small = small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        following = scratch.put(small)
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = following
        if state == seen:
            break
        seen = state
    return current.select("u", F.col("v").alias("root")).union(current.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())

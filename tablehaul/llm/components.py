"""Connected components of links, by alternating stars, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import stored


def _smallest(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """Each u with the smallest of itself and its v; summed up before the shuffle, so a hub is no hot key."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_self:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns node, component: the smallest node that can be reached.

    Alternates large stars and small stars (Kiveris et al. 2014) until nothing moves; each round
    is written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: a node's larger neighbours go to its smallest.
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links-large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = _smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), keep_self=True)
        edges = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # Every edge now points from a node to its component's smallest.
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of an edge table, by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, total


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges(a, b) -> (node, component) for every node on an edge; component is the least node reachable.

    Each step hooks nodes to the least neighbour seen; edges are kept distinct and written to the shared folder after each
    round, so their number never grows and a lost executor repeats no earlier round. Self-loops and repeats are allowed; nodes
    that only loop to themselves, and null nodes, are not returned. most: edges there are at most, if known.
    """
    sums = {"sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}  # changes show in it
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct(), most, **sums)
    before = total(now), total(now, "sum")
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        old = now
        now = cut(small, before[0], **sums)
        after = total(now), total(now, "sum")
        drop(old)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

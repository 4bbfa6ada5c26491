"""Connected components by alternating large-star and small-star steps. No link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b), component being the smallest id that can be reached.

    Each step keeps the graph connected and shortens every path; it ends with one star per component. Neighbour minima
    combine on the map side and AQE splits the join of a hub with many neighbours.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    held = written(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    seen = _mark(held)
    while seen[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = written(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(held)
        if now == seen:
            break
        seen = now
    roots = held.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges: equal marks mean that a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0)))"), F.expr("bit_xor(xxhash64(v, u))")).first())

"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from custlytics.llm.common import settled


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours; sums by u are combined before they are
    dealt out, and the join splits a u with very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("m", F.least("u", "least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) for every node that has a link; a component is its least node.

    Each round ties the larger neighbours of every node to its least neighbour, and then the smaller
    ones, until nothing changes; rounds grow with the logarithm of the number of nodes. One checkpoint
    per round, before which the steps of the round before are released. Repeated links and links of a node with itself are allowed; no links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        tied = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(tied)
        down = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(down.union(small.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select("component", "component")).distinct()

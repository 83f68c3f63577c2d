"""Connected components by alternating large-star and small-star rounds, each an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: hang neighbours on the smallest node of their neighbourhood.

    Only minima are aggregated and joined back, so no neighbourhood is ever collected; the join of a hub
    with a large share of the edges is one that adaptive execution may split.
    """
    directed = (edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = directed.join(least, "u")
    if large:
        return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node reachable.

    Loops, repeated edges and NULL ends are ignored. Every round is written to the shared folder, so a lost
    executor costs at most one round. An empty table gives an empty result.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    current = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .distinct(), purpose)
    # finished when every node hangs on one other at most, and none hangs on a node that hangs itself
    while not (current.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).union(current.select("v", F.lit(0)))
               .groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("holds"))
               .filter("hangs > 1 OR hangs > 0 AND holds = 0").isEmpty()):
        current = materialise(_star(_star(current, large=True), large=False), purpose)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

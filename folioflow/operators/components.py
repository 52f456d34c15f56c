"""Connected components of an edge table by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.runtime import cut


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star round: every neighbour of a node is linked to the least node of its neighbourhood."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    far = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both_ways else joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is the least node of it.

    Edges are undirected; null ends, loops and repeated edges have no effect; an empty table gives an empty result. Each
    round is a few aggregations and joins whose result is written to the shared checkpoint folder; the number of rounds
    grows with the logarithm of the longest path. Nothing of the graph reaches the driver but a checksum per round.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null and u <> v")
    e, seen = cut(e.distinct()), None
    for _ in range(rounds):
        e = _stars(e, True)  # large stars: from each node down to the least of all neighbours
        e = cut(_stars(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))  # small stars
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

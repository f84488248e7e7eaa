"""Connected components of a large graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import pinned, shuffles_removed


def _mark(edges: DataFrame) -> tuple:
    with shuffles_removed(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of u, or u itself; partial minima keep a hub from meeting in one task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for all nodes of the links (u, v) but those that are their own label.

    Each round first hangs every larger neighbour of a node on the least one around it, then every smaller one; both keep
    components as they are and at most one edge per node and round. About log of the longest path rounds; every round is
    checkpointed. No edges give no rows.
    """
    edges = edges.where(F.col("u") != F.col("v"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = pinned(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pinned(large.where(F.col("u") != F.col("v")).distinct())
        small = large.join(_least(large), "u")
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = pinned(hung.where(F.col("u") != F.col("v")).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))

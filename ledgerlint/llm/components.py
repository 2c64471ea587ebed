"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlint.sources.tables import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(lowest, "a").where(F.col("b") > F.col("a"))
            .select(F.least("a", "m").alias("a"), "b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    lowest = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(lowest, "b").where(F.col("a") != F.col("m")).select(
        F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(lowest.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of an edge table (a, b) with a < b; a component is named by
    its smallest node. Repeated edges do no harm, an edge with a null is no edge. Each round is
    written, so a lost executor costs one round at most."""
    edges = materialise(edges.where(F.col("a") < F.col("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

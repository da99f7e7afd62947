"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import join_spread, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or the node itself); a node with a large share of all edges is spread."""
    near = _both_ways(edges)
    least = materialise(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.sum(F.when(F.col("b") > F.col("a"), 1).otherwise(0)).alias("n")).where("n > 0"), "stars")
    return join_spread(near.where("b > a"), least, ["a"]).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them; edges have a < b."""
    edges = materialise(edges, "edges")
    least = materialise(edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "stars")
    moved = join_spread(edges, least.where("n > 1"), ["b"]).where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _print_of(edges: DataFrame) -> tuple:
    # Decimal sums: a sum of 64-bit hashes would overflow.
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) for every node of an edge; edges: (a, b), any order, repeats and loops allowed.

    The number of rounds grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen, now = None, _print_of(edges)
    while now != seen and now[0]:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        seen, now = now, _print_of(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

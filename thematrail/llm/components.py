"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.filter("v > u").join(least.select(F.col("u"), F.least("u", "m").alias("m")), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``edges`` (a, b bigint); a component is named by its smallest node.

    Links may be repeated, reversed or point to their own node (those and links with nulls count for nothing;
    such a node is left out). Sums and joins are by node and Spark splits a node with very many links; every
    round is written to the shared folder and the rounds are about the logarithm of the longest chain.
    """
    edges = written(edges.toDF("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now

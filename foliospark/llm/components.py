"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small


def _spread(least: DataFrame) -> DataFrame:
    """Written first, so that a node with very many neighbours (the hub of a star) is broadcast or its part of a shuffled join can be split."""
    return small(cut(least), F.lit(32))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on its smallest neighbour (or on itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(_spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node (u > v in all edges) and its smaller neighbours are hung on the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    least = _spread(least)
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` is connected to; roots are left out.

    Every step keeps at most as many edges as there were and ends up with stars;
    the number of steps grows with the logarithm of the longest path. Each step
    is written to the shared checkpoint folder. Self-loops and repeats are fine.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    last = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("s")).first()
        if now["n"] == 0 or now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
        e = cut(_small_star(_large_star(e)))

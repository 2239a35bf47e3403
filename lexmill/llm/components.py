"""Connected components of a table of links, without collecting it.

Alternating large-star and small-star steps: every node points to the smallest
node of its neighbourhood until all edges are stars. Each step is a grouped
minimum (summed before the shuffle) and a join, so a hub does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down (a > b): each of a's lower neighbours, and a itself, are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none."""
    down = edges.groupBy("a").agg(F.count("*").alias("n"))
    return not down.where("n > 1").union(down.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")).take(1)


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of different ids -> (id, component): the least id of each linked node's component."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _stars(edges):
        edges = checkpoint(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()

"""Connected components of a graph given by edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import spread
from fanfold.session import in_tasks, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); a component's number is its smallest node.

    A node's neighbours are never gathered: minima are aggregated in every task first and joined back. Each step is written
    to the shared folder, by as many tasks as its edges need; a logarithmic number of them is usual.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count, done = _state(now)
    while not done:
        now = materialize(in_tasks(_small_star(_large_star(in_tasks(now, count), count), count), count))
        count, done = _state(now)
    now = in_tasks(now, count)
    # What is left is stars: every node points at its component's smallest.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: no node points at two others, or at one that points on."""
    nodes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("ups"))
    count, most = nodes.agg(F.sum("ups"), F.max("ups")).first()
    ends = edges.select(F.col("b").alias("a")).distinct()
    return count or 0, (most or 0) <= 1 and ends.join(nodes, "a", "left_semi").isEmpty()


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours.

    Edges point at the smaller node, so an edge's first node is the larger neighbour of its second, and a node's smallest
    neighbour is the smallest that it points at.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    moved = edges.join(spread(least, count), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    return in_tasks(in_tasks(moved, count).distinct(), count)


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Joins every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # The smallest neighbour itself stays as the node's own edge.
    moved = edges.join(least, "a").select(
        F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return in_tasks(moved, count).distinct()

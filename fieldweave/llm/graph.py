"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two aggregations and two joins on the edges; nothing is collected.  The number of
steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: links each neighbour of a node (large: the greater ones, small: the smaller ones and itself) to the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Nodes without an edge do not appear; an edge from a node to itself is no edge.
    """
    now = edges.select("a", "b").where("a != b")
    while True:
        now = scratch.keep(_star(_star(now, True), False), "edges")
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
            now.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root"))
        )
        # Done when every node has one parent at most, and no parent has one: a forest of stars.
        open_ = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if open_.where("child > 1 or (child = 1 and root = 1)").isEmpty():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

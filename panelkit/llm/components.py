"""Connected components of links by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours.

    The smallest ones are written first: then both sides of the join are plain shuffles, and adaptive execution can split
    the partition of a node with very many neighbours."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. In every link, a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b), in either order, repeats allowed. Returns (node, component): the smallest node that links reach.

    Nodes without a link do not appear. Each round shrinks paths by a constant factor; it ends when a round changes
    nothing, which shows in the count and in a sum over all links, so no link reaches the driver.
    """
    step = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        step = materialize(_small_star(_large_star(step).distinct()).distinct(), "links")
    return step.select(F.col("b").alias("node"), F.col("a").alias("component")).union(step.select(F.col("a"), F.col("a")).distinct())

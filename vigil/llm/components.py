"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def stars(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component, from links (a, b).

    Each step moves links toward smaller nodes; minima are aggregated first and written, so that the
    join that follows has one row a node on one side and may split a hub's links on the other.
    """
    edges = saved(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = saved(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        moved = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, which has none."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").take(1)

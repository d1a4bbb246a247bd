"""Connected components by alternating stars, with plain joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import release
from sentiloom.session import cut


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of its neighbours ``v`` (pre-aggregated before the shuffle)."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return least.select("u", F.col("m").alias("v")).unionByName(
        down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node still has two edges down, or is both a child and a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    met = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return not met.filter("child > 1 or (child = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), u <> v, of any sortable type -> (node, root): the least node of each component.

    Only nodes with an edge are returned.  The rounds grow with the logarithm of the longest path; each ends in a
    checkpoint, so a lost executor costs one round at most, and they end as soon as all edges form stars.  Nothing but one row
    per round reaches the driver.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(edges):
        edges = cut(_small_star(_large_star(edges)))
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from confab.session import cut


def rough_components(edges: DataFrame) -> DataFrame:
    """(node, component) by two steps to the smallest neighbour: equal labels mean one component, but a component may have several."""
    both = edges.toDF("src", "dst").union(edges.select(edges.columns[::-1]).toDF("src", "dst"))
    least = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "least_neighbours")
    next_one = least.select(F.col("src").alias("m"), F.col("m").alias("mm"))
    return cut(least.join(next_one, "m").select(F.col("src").alias("node"), F.col("mm").alias("component")), "rough_components")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); the component is its smallest node.

    Ends when the edges are stars: every source has one edge and no centre is a source. Only the answer to that reaches the driver.
    """
    current = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                  .where("src <> dst").distinct(), "edges")
    while not _stars(current):
        both = current.union(current.select(F.col("dst"), F.col("src"))).toDF("src", "dst")
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
            least.where("m < src").select("src", F.col("m").alias("dst"))).where("src <> dst")
        large = cut(large, "large_star")
        lowest = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(lowest, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
            lowest.select("src", F.col("m").alias("dst"))).distinct()
        current = cut(small, "small_star")
    stars = current.toDF("node", "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (src, dst) are stars around their targets."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()

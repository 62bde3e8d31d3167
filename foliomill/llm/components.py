"""Connected components of undirected links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.sources import workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = workspace.written(
        both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = workspace.written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that (u, v) links name: the smallest node it can reach.

    Each step is written to the shared folder, so lineage stays short and a lost executor costs its
    tasks of one step; and as the least neighbours are read back, the join with them has a shuffle of
    its own on either side, whose skewed partitions can be split at a node with very many links. Rounds are few, logarithmic in the longest path. Loops and repeated links
    do no harm; links with a null end are left out.
    """
    now = workspace.written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
            F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    state = None
    while True:
        before, state = state, now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        large = workspace.written(_large_star(now).distinct(), "links")
        now = workspace.written(_small_star(large).distinct(), "links")
    least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return least.unionByName(least.select(F.col("component").alias("node"), "component").distinct())

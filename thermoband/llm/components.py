"""Connected components of a graph given by its links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.session import Scratch, durable


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the least of its neighbours and itself."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node tells its smaller neighbours and itself the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    told = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return told.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b: long) as (node, component): each linked node with the least node it can reach.

    Alternating large and small stars: the links shrink to one star per
    component in a number of rounds that grows with the logarithm of the
    largest component. A node with very many links meets its least neighbour
    in a join that adaptive execution can split; nothing is gathered per node.
    Each round is written to the shared folder in place of the one before. Nulls, self links and repeated
    links do not count; no links give no rows.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    with Scratch(links.sparkSession) as scratch:
        links = scratch.replaced(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = None
        while True:
            now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == state or not now[0]:
                return durable(
                    links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
                )
            state = now
            links = scratch.replaced(_small_star(_large_star(links).distinct()).distinct())

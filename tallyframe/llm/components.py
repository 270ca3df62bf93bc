"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them and the node itself; all larger ones, or all others."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("node"), "m")
    met = both.join(least, F.col("a") == F.col("node"))
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    to = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return to.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `label`: the smallest node that each node of links (a, b) reaches. Links join numbers, in any order, repeated or not.

    Every round is written to the shared folder, so no lineage grows and no link comes to the driver; what comes is a
    count and a checksum that tell when a round changes nothing. Nodes of many links are only ever pre-aggregated or joined.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark.n:
            break
        seen = mark
        nxt = written(_star(_oriented(_star(now, True)), False), "links")
        removed(now.sparkSession, now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")

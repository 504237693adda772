"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is joined to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, "a").where(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are joined to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node` and `root`, the least node it is linked with, for every node above its root.

    Ends when a round changes nothing; rounds grow with the logarithm of a component's
    diameter. Each round writes its edges, of which there are fewer each time, and only
    their number and a checksum reach the driver. A node with many links is aggregated
    before the shuffle and split by the adaptive join; no list of neighbours is built.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    seen = None
    while True:
        now = written(_small_star(_large_star(now)))
        mark = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))
        ).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark

"""Connected components of a link table, by rounds of joins; nothing is gathered on the driver but one number per round."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.session import pinned

MAX_ROUNDS = 60


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished rounds now: Spark removes them once their plans are collected as garbage, which a driver seldom does by itself."""
    gc.collect()
    spark._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node of its component.

    ``links``: (a, b), two columns of one type, any order, loops and repeats allowed. Alternating large-star and small-star rounds: a star
    of any size is one row per node, so a hub is never expanded, and every round at least halves the paths in practice. Links are
    done when they are stars: none leads to a node from which another leads on.
    """
    links = pinned(_ordered(links))
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        links = pinned(_small_star(_large_star(links)))
        if links.join(links.select(F.col("a").alias("_on")), F.col("b") == F.col("_on"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    release(links.sparkSession)
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours; repeats are left to the next step."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    down = links.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b")
    return down.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()

"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlab.session import materialise


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nearest = _nearest(down)
    tied = down.join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(nearest.select("a", F.col("m").alias("b"))).where("a <> b")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, component), the component being its smallest node.

    Nodes without a link do not appear. The links are written after each round, so no round
    depends on shuffle files of earlier ones; large stars are joined with a table that holds one
    row per node, which lets adaptive execution split them. Ends after O(log^2 n) rounds.
    """
    now = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = _mark(now)
    while mark[0]:
        now = materialise(_small_star(_large_star(now).distinct()).distinct(), "links")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

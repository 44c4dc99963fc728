"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.session import written

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); the root is the smallest node of the component.

    Each round hands the smallest node that a node knows to its larger neighbours, then to its smaller ones, so rounds
    grow with the logarithm of the longest chain. What a node knows is the result of a join, never one gathered group.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known, before = written(pairs, "links"), None
    for _ in range(MAX_ROUNDS):
        both = known.union(known.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("low"))
        down = up.join(least, "a")
        both = down.select(F.col("b").alias("a"), F.col("low").alias("b")).union(down.select("a", F.col("low").alias("b")))
        known = written(both.where("a != b").distinct(), "links")
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return known.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                known.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle")

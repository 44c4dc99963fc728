"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import written

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); the root is the smallest node of the component.

    Rounds of two star steps: each node hands the smallest node it knows to its larger neighbours, then to its smaller
    ones. Rounds grow with the logarithm of the longest chain. Every round is written to the shared folder. Nodes with
    very many links are met by joins, whose large partitions the session may split; nothing is gathered per node.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "links"), None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        edges = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        smallest = edges.groupBy("a").agg(F.min("b").alias("low"))
        edges = edges.join(smallest, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        edges = written(edges.select("e.*").where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

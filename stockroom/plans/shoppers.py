"""Shopper behaviour: views, recently viewed, favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.operators.keyed import first_per_key


def view_counts(views: DataFrame, products: DataFrame) -> DataFrame:
    """Detail views per published product."""
    counted = views.groupBy("product_id").agg(F.count(F.lit(1)).alias("view_count"))
    shown = products.where(P.published()).select(F.col("id").alias("product_id"))
    return counted.join(shown, "product_id", "left_semi")


def recently_viewed(views: DataFrame, count: int = V.RECENTLY_VIEWED) -> DataFrame:
    """Per user the last `count` different products, newest view first."""
    latest = views.groupBy("user_id", "product_id").agg(F.max(F.struct("created_at", "id")).alias("_seen"))
    flat = latest.select("user_id", "product_id", F.col("_seen.created_at").alias("viewed_at"), F.col("_seen.id").alias("_id"))
    return first_per_key(flat, ["user_id"], [F.desc("viewed_at"), F.desc("_id")], count, rank="position").drop("_id")


def favourites(toggles: DataFrame) -> DataFrame:
    """A product is a favourite after an odd number of toggles."""
    counted = toggles.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("toggle_count"))
    return counted.where(F.col("toggle_count") % 2 == 1)

"""Slugs for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.text import slugify
from stockroom.operators.prefixes import lowest_under

#: Stands for all existing rows: they come before every new one.
_BEFORE = -2 ** 63


def assign_slugs(new: DataFrame, existing: DataFrame, name: str = "name", ranges: int | None = None) -> DataFrame:
    """Slug per new row; taken ones get the row's id appended.

    A slug is taken if an existing slug, or that of a new row with a lower id, starts with it.
    """
    based = new.withColumn("_base", slugify(F.col(name)))
    known = based.select(F.col("_base").alias("text"), F.col("id").cast("bigint").alias("number")).union(
        existing.select("slug", F.lit(_BEFORE)))
    lowest = lowest_under(known, ranges).select(F.col("text").alias("_base"), "lowest")
    joined = based.join(lowest, "_base", "left")
    slug = F.when(F.col("lowest") < F.col("id"), F.concat_ws("-", "_base", F.col("id").cast("string"))).otherwise(F.col("_base"))
    return joined.withColumn("slug", slug).drop("_base", "lowest")

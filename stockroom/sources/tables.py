"""Operational tables from files or a database, and small literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.schemas import SCHEMAS


def read_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    """One table from Parquet below `root`, with its fixed schema (no inference pass)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, name: str, url: str, lower: int, upper: int, partitions: int,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """One table from a database, read in `partitions` ranges of `id` in parallel.

    `lower` and `upper` only place the ranges; rows outside them are read too.
    """
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", name)
              .option("partitionColumn", "id").option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", partitions))
    loaded = reader.options(**(properties or {})).load()
    return loaded.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in SCHEMAS[name].fields
                           if f.name in loaded.columns])


def literal_table(spark: SparkSession, name: str, rows: Iterable[Mapping]) -> DataFrame:
    """A small table from literal rows; columns left out are null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)


def load_tags(products: DataFrame, slug_tags: DataFrame) -> DataFrame:
    """Resolve (slug, tag) rows to product ids; unknown slugs drop out, doubles count once."""
    return (slug_tags.join(products.select(F.col("id").alias("product_id"), "slug"), "slug")
            .select("product_id", "tag").distinct())


def save_table(df: DataFrame, name: str, root: str) -> None:
    """Facts are partitioned by day, so that date filters skip whole folders."""
    writer = df.write.mode("overwrite")
    if name in ("orders", "stock_transactions", "activity_logs", "notifications"):
        writer = df.withColumn("created_on", F.to_date("created_at")).write.mode("overwrite").partitionBy("created_on")
    writer.parquet(f"{root}/{name}")

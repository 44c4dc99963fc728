"""Substring search in saved tables without reading all of them: postings of letter triples.

A text that holds a term holds every three letters of it in a row, so the rows to look at are those that have all of the term's triples;
the condition itself is then checked on them. Case is ignored as in `filters.search` with `ascii_only`; accents are told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators.filters import search
from stockroom.sources.saved import BUCKET, bucket_of, save_buckets

GRAM = 3


def grams_of(text: Column) -> Column:
    """The distinct triples of a text in lower case; null and shorter texts have none."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substr(low, at, F.lit(GRAM))))


def save_search(df: DataFrame, key: str, columns: Sequence[str], path: str, buckets: int = 64) -> None:
    """Save the rows in buckets by `key` (unique, not null) and the postings (triple, key) in buckets by triple, sorted by triple."""
    save_buckets(df, key, f"{path}/rows", buckets)
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams_of(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    postings = df.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).withColumn(BUCKET, bucket_of(F.col("gram"), buckets))
    # A frequent triple is dealt over several tasks by its key; each sorts its part, so readers skip what they do not ask for.
    dealt = postings.repartition(BUCKET, F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions(BUCKET, "gram")
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/postings")


def candidates(spark: SparkSession, key: str, path: str, term: str, buckets: int = 64) -> DataFrame | None:
    """The keys of rows that have all triples of `term`; None if it is too short to have any."""
    asked = spark.range(1).select(F.explode(grams_of(F.lit(term))).alias("gram")).select("gram", bucket_of(F.col("gram"), buckets)).collect()
    if not asked:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col(BUCKET).isin(sorted({b for _, b in asked})) & F.col("gram").isin([g for g, _ in asked]))
    return found.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("_met")).where(F.col("_met") == len(asked)).select(key)


def search_saved(spark: SparkSession, key: str, path: str, term: str | None, columns: Sequence[str], buckets: int = 64) -> DataFrame:
    """The rows that `filters.search` with `ascii_only` would find in the saved table.

    Terms under three letters (and no term) read all rows. Otherwise only buckets that hold a candidate are read, and of these the candidates.
    """
    rows = spark.read.parquet(f"{path}/rows")
    keys = candidates(spark, key, path, term, buckets) if term else None
    if keys is not None:
        touched = [r[BUCKET] for r in keys.select(bucket_of(F.col(key), buckets).alias(BUCKET)).distinct().collect()]  # at most `buckets`
        rows = rows.where(F.col(BUCKET).isin(touched)).join(keys, key, "left_semi")
    return search(rows.drop(BUCKET), term, columns, ascii_only=True)

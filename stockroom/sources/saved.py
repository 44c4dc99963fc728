"""Saved tables that are changed in place: rows lie in buckets by key, and a change rewrites the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.session import written

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    # One file per bucket; the buckets of a change keep their number of writers small.
    (df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(path))


def save_buckets(df: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Save a table so that `change_buckets` can rewrite parts of it. Choose `buckets` so that one fits a task."""
    _write(df.withColumn(BUCKET, bucket_of(F.col(key), buckets)), path, "static")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def change_buckets(spark: SparkSession, key: str, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame],
                   buckets: int = 64) -> list[int]:
    """Apply `change` (old rows to new rows) to the buckets that hold any of `keys` (a frame with the column `key`), and to no others.

    `change` must only add or alter rows with these keys; it may drop rows. The new rows are written aside first, so a job that fails
    leaves the table as it was until the buckets are exchanged. Returns the rewritten buckets; at most `buckets` numbers reach the driver.
    """
    touched = [r[BUCKET] for r in keys.select(bucket_of(F.col(key), buckets).alias(BUCKET)).distinct().collect()]
    if touched:
        stored = spark.read.parquet(path)
        changed = change(stored.where(F.col(BUCKET).isin(touched)).drop(BUCKET))
        fresh = written(changed.select(*[c for c in stored.columns if c != BUCKET], bucket_of(F.col(key), buckets).alias(BUCKET)), "buckets")
        _write(fresh, path, "dynamic")
        left = {r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()}
        for bucket in set(touched) - left:  # nothing was written over these
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(touched)

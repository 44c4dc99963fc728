"""Sources and sinks for the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
               max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, column: str = "created_at", delay: str = "1 day") -> DataFrame:
    return stream.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark("event_time", delay)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet, exactly once, until the available input is used up."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append") -> StreamingQuery:
    """Run `work(rows, batch_id)` per micro-batch. A batch may be repeated after a failure, so work must
    write to places named by the batch id and overwrite them."""
    return (stream.writeStream.outputMode(mode).foreachBatch(work)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def update_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed result rows below `path`, one folder per batch; `newest_rows` reads them."""
    def work(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each_batch(stream, work, checkpoint, "update")


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of every key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def whole_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the whole result (complete mode) after every batch, one folder per batch; `newest_result` reads the last."""
    def work(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each_batch(stream, work, checkpoint, "complete")


def newest_result(spark: SparkSession, path: str) -> DataFrame:
    """The result after the last batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch").drop("batch")

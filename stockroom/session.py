"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stockroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; `master` and `conf` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rounds write checkpoints; those no longer referenced are removed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, for sessions whose workers do not have it installed."""
    import shutil

    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stockroom-package-")  # the driver serves the archive; executors fetch it from there
    archive = shutil.make_archive(os.path.join(folder, "stockroom"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder; on a cluster an unset folder is an error,
    because files on one machine are lost with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
            named = tempfile.mkdtemp(prefix="stockroom-")
        context.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the written rows (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), "work", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as soon as it ends, not when the driver happens to collect its garbage. For rows that
    are written: nobody asks for the shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` once as Parquet to the shared folder and go on from the files (survives lost executors, which cost no recomputation)."""
    path = work_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables written on the way give the disk of their shuffles back."""

from __future__ import annotations

import gc

import pytest

from stockroom import session
from stockroom.llm import common, phrases, suffixes

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("write", [session.written, common.written, phrases.written])
def test_shuffles_go_with_the_write(spark, write):
    setting, before = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    rows = spark.range(5000).selectExpr("id % 50 as k", "id").repartition(3, "k")
    kept = write(rows.sortWithinPartitions("id"), "rows")
    assert shuffle_files(spark) <= before
    assert kept.count() == 5000 and kept.columns == rows.columns and spark.conf.get(CLEANUP, None) == setting


def test_sorted_runs_leave_no_shuffle(spark):
    docs = suffixes.keyed(spark.range(40).selectExpr("id as doc_id", "repeat(concat('some words that stand in many texts ', id % 7, ' '), 9) as text"))
    gc.collect()
    before = shuffle_files(spark)
    found = suffixes.covered(docs, 100)
    assert shuffle_files(spark) <= before  # both sorts are written by now
    assert found.count() == 40

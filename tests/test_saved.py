"""Saved pages, saved buckets and exports."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from stockroom.operators.paging import save_pages, saved_page
from stockroom.sources.saved import change_buckets, read_buckets, save_buckets
from stockroom.sources.sinks import write_report

ORDER = [("k", False), ("t", True), ("id", True)]


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    found = [(i, rng.randint(0, 6), rng.choice("abé")) for i in range(203)]
    return found, spark.createDataFrame(found, "id int, k int, t string").repartition(4)


@pytest.mark.parametrize("ranges", [1, 6])
def test_every_page_ties_included(spark, rows, tmp_path, ranges):
    found, df = rows
    save_pages(df, ORDER, str(tmp_path), 25, ranges=ranges)
    want = [r[0] for r in sorted(found, key=lambda r: (-r[1], r[2].encode(), r[0]))]
    for page in range(1, 11):
        assert [r.id for r in saved_page(spark, ORDER, str(tmp_path), page).collect()] == want[(page - 1) * 25:page * 25]
    save_pages(df.limit(0), ORDER, str(tmp_path / "none"), 25)
    assert saved_page(spark, ORDER, str(tmp_path / "none"), 1).count() == 0


def test_a_deep_page_reads_no_more_than_the_first(spark, tmp_path):
    """Both ends of a page reach the files: folders by number, row groups by the leading column."""
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    order = [("k", True)]
    save_pages(df, order, str(tmp_path), 50, ranges=20)
    for page in (1, 399):
        made = saved_page(spark, order, str(tmp_path), page)
        assert [r.k for r in made.collect()] == list(range(50 * page - 50, 50 * page))
        plan = made._jdf.queryExecution().toString()
        assert "Offset" not in plan and "GlobalLimit" not in plan
        scan = made._jdf.queryExecution().executedPlan().toString()
        folders = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert ">=" in folders and "<=" in folders
        assert "GreaterThanOrEqual(k" in scan and "LessThanOr" in scan  # the plan shortens long lists


def _files(path):
    return {f: f.split("bucket=")[1].split("/")[0] for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_a_change_rewrites_its_buckets_only(spark, rows, tmp_path):
    found, df = rows
    path = str(tmp_path / "t")
    save_buckets(df, "id", path, 8)
    before = _files(path)
    patch = spark.createDataFrame([(17, "new")], "id int, t string")

    def change(old):
        return old.join(patch.withColumnRenamed("t", "_t"), "id", "left").withColumn("t", F.coalesce("_t", "t")).drop("_t")

    touched = change_buckets(spark, "id", path, patch, change, 8)
    after = _files(path)
    assert len(touched) == 1
    assert {b for f, b in before.items() if f not in after} == {str(touched[0])} == {b for f, b in after.items() if f not in before}
    assert sorted(map(tuple, read_buckets(spark, path).select("id", "k", "t").collect())) == [(i, k, "new" if i == 17 else t) for i, k, t in found]


def test_deletes_new_rows_and_nothing(spark, rows, tmp_path):
    found, df = rows
    path = str(tmp_path / "t")
    save_buckets(df, "id", path, 400)  # nearly every row alone in its bucket
    gone = spark.createDataFrame([(3,), (9000,)], "id int")
    change_buckets(spark, "id", path, gone, lambda old: old.join(gone, "id", "left_anti"), 400)
    added = spark.createDataFrame([(5000, 1, "z")], "id int, k int, t string")
    change_buckets(spark, "id", path, added.select("id"), lambda old: old.unionByName(added), 400)
    assert change_buckets(spark, "id", path, gone.limit(0), lambda old: old.limit(0), 400) == []
    assert sorted(r.id for r in read_buckets(spark, path).collect()) == [i for i, *_ in found if i != 3] + [5000]


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_report_rows_are_numbered_in_order(spark, rows, tmp_path, form):
    found, df = rows
    order = [F.desc("k"), F.asc("t"), F.asc("id")]
    write_report(df, order, df.agg(F.count("*").alias("n")), str(tmp_path), form, ranges=5)
    reader = spark.read.option("header", True).option("inferSchema", True) if form == "csv" else spark.read
    back = reader.format(form).load(f"{tmp_path}/rows").collect()
    want = [r[0] for r in sorted(found, key=lambda r: (-r[1], r[2].encode(), r[0]))]
    assert [r.id for r in sorted(back, key=lambda r: r.row_no)] == want
    assert sorted(r.row_no for r in back) == list(range(1, 204))
    first, last = {}, {}
    for r in back:  # folders follow each other
        first[r.part], last[r.part] = min(first.get(r.part, r.row_no), r.row_no), max(last.get(r.part, 0), r.row_no)
    parts = sorted(first)
    assert len(parts) > 1 and all(last[a] + 1 == first[b] for a, b in zip(parts, parts[1:]))
    assert reader.format(form).load(f"{tmp_path}/header").first().n == 203

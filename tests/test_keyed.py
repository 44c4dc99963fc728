"""Sliced per-key calculations give the same rows as plain windows, one key holding most of the data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.operators.keyed import KeyedOrder, cut_points, first_per_key
from stockroom.operators.nesting import child_arrays, with_children


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(30), i, rng.choice([None, 1, 2, 3, -4]))
            for i, k in enumerate([1] * 900 + [2] * 90 + list(range(3, 40)))]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k long, at long, id long, v long").repartition(5)


def _plain(rows):
    w = Window.partitionBy("k").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "k", "at", "id", "v", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("run"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("run_before"), F.row_number().over(w).cast("long").alias("n"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("newest"),
        F.last("v", True).over(before).alias("newest_before"), F.lag("v").over(w).alias("prev"))


@pytest.mark.parametrize("per_slice", [7, 400, 10_000])
def test_same_as_plain_window(rows, per_slice):
    k = KeyedOrder(rows, ["k"], ["at", "id"], rows_per_slice=per_slice)
    assert k.sliced == (per_slice < 10_000)
    v = F.col("v")
    got = (k.running_sum(v, "run").running_sum(v, "run_before", False).row_number("n")
           .last_value(v, "newest").last_value(v, "newest_before", False).previous(v, "prev").result())
    columns = ["k", "at", "id", "v", "run", "run_before", "n", "newest", "newest_before", "prev"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, _plain(rows).select(*columns).collect()))


def test_hot_key_is_spread_and_others_are_not(rows):
    k = KeyedOrder(rows, ["k"], ["at", "id"], rows_per_slice=50)
    sizes = {(r["k"], r["_slice"]): r["count"] for r in k.df.groupBy("k", "_slice").count().collect()}
    hot = [n for (key, _), n in sizes.items() if key == 1]
    assert len(hot) > 8 and max(hot) < 300
    assert all(s == 0 for key, s in sizes if key > 2)


def test_no_cuts_without_hot_key(rows):
    assert cut_points(rows, ["k"], ["at", "id"], 1000) is None
    assert cut_points(rows.where("k > 2"), ["k"], ["at", "id"], 5) is None


def test_whole_table_as_one_key(rows):
    one = rows.withColumn("all", F.lit(0))
    numbered = KeyedOrder(one, ["all"], ["at", "k", "id"], rows_per_slice=100).row_number("n").result()
    got = [r["id"] for r in numbered.orderBy("n").select("id").collect()]
    assert got == [r["id"] for r in rows.orderBy("at", "k", "id").collect()]


def test_first_per_key_limits_before_the_shuffle(rows):
    top = first_per_key(rows, ["k"], [F.desc("at"), F.desc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert top.count() == 3 + 3 + 37


def test_child_arrays_continue_in_parts(spark, rows):
    parts = child_arrays(rows, "k", ["at", "id"], ["id"], "children", part_rows=100, rows_per_slice=50)
    hot = parts.where("k = 1").orderBy("part_no").collect()
    assert [len(p["children"]) for p in hot] == [100] * 9
    ids = [c["id"] for p in hot for c in p["children"]]
    assert ids == [r["id"] for r in rows.where("k = 1").orderBy("at", "id").collect()]
    parents = spark.createDataFrame([(1,), (77,)], "id long")
    joined = with_children(parents, "id", parts, "k", "children")
    assert joined.count() == 10
    assert joined.where("id = 77").first()["children"] == []

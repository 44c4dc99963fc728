"""Streams over several files give the batch result."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.plans import ledger, notify, workflow
from stockroom.sources.testdata import MOVE_ORDER
from stockroom.streaming import flow, posting, run


def arriving(spark, df, path, files, by):
    """Write `df` as files whose order of arrival follows `by`."""
    import os
    import time
    ordered = df.withColumn("_part", F.ntile(files).over(Window.orderBy(*by)))
    for n in range(1, files + 1):
        ordered.where(F.col("_part") == n).drop("_part").coalesce(1).write.parquet(f"{path}/{n}")
        for name in os.listdir(f"{path}/{n}"):
            os.utime(f"{path}/{n}/{name}", (time.time() + n, time.time() + n))
    return run.read_files(spark, f"{path}/*", df.schema, max_files=1)


def restarted(parts, start):
    """`parts`: (frame, folder) pairs per step; all of a step arrive, then the stream is started anew."""
    for step in parts:
        for frame, folder in step:
            frame.coalesce(1).write.mode("append").parquet(folder)
        start().awaitTermination()


def in_thirds(df, by):
    ordered = df.withColumn("_part", F.ntile(3).over(Window.orderBy(*by)))
    return [ordered.where(F.col("_part") == n).drop("_part") for n in (1, 2, 3)]


@pytest.fixture
def shop(t):
    moves = t.movements.where("product_id % 40 = 3").withColumn("order_id", F.when(F.col("id") % 5 != 0, F.col("order_id")))
    odd = moves.limit(4).withColumn("type", F.element_at(F.array(*map(F.lit, ["lost", "in", "out", "in"])), (F.monotonically_increasing_id() % 4 + 1).cast("int")))
    odd = odd.withColumn("qty", F.lit(0)).withColumn("id", F.col("id") + 9_000_000).unionByName(
        moves.limit(2).withColumn("product_id", F.lit(-5).cast("long")).withColumn("id", F.col("id") + 8_000_000))
    opening = t.products.select(F.col("id").alias("product_id"), F.col("warehouse_stock").alias("opening_qty"))
    return moves.unionByName(odd), opening


def test_ledger_goes_on_after_restarts(spark, shop, tmp_path):
    moves, opening = shop
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(part, folder)] for part in in_thirds(moves, MOVE_ORDER)]
    parts[0][0][0].limit(0).write.parquet(folder)
    stream = run.read_files(spark, folder, moves.schema)
    restarted(parts, lambda: posting.post_stream(stream, opening, out, str(tmp_path / "cp"), MOVE_ORDER))
    columns = ["product_id", "created_at", "id", "type", "qty", "qty_before", "qty_after"]
    want, rejects = ledger.post_ledger(opening, moves, MOVE_ORDER)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.where("reason is null").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    refused = got.where("reason is not null")
    assert sorted(map(tuple, refused.select("product_id", "id", "reason").collect())) == sorted(
        map(tuple, rejects.select("product_id", "id", "reason").collect()))
    assert {r.reason for r in refused.collect()} >= {"type_invalid", "qty_invalid", "product_not_found", "insufficient_stock"}


def test_alerts_follow_the_posted_balances(spark, t, shop, tmp_path):
    moves, opening = shop
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(part, folder)] for part in in_thirds(moves, MOVE_ORDER)]
    parts[0][0][0].limit(0).write.parquet(folder)
    stream = run.read_files(spark, folder, moves.schema)
    restarted(parts, lambda: posting.alert_stream(stream, opening, t.products, out, str(tmp_path / "cp"), MOVE_ORDER))
    want = notify.stock_alert(ledger.post_ledger(opening, moves, MOVE_ORDER)[0], t.products)
    got = spark.read.parquet(out).select(*want.columns)
    assert want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_spend_and_notes_across_batches(spark, t, tmp_path):
    changes = t.order_changes.where("order_id % 10 = 1")
    orders = t.orders.where("id % 10 = 1").withColumn("status", F.lit("pending")).withColumn("payment_status", F.lit("unpaid"))
    folder, placed, out = str(tmp_path / "in"), str(tmp_path / "placed"), str(tmp_path / "out")
    missing = orders.agg(F.max("id")).first()[0]  # its payments find no order
    parts = list(zip([(p, folder) for p in in_thirds(changes, workflow.CHANGE_ORDER)],
                     [(p, placed) for p in in_thirds(orders.where(F.col("id") != missing), ["created_at", "id"])]))
    parts[0][0][0].limit(0).write.parquet(folder)
    parts[0][1][0].limit(0).write.parquet(placed)
    stream, arriving_orders = run.read_files(spark, folder, changes.schema), run.read_files(spark, placed, orders.schema)
    restarted(parts, lambda: posting.payment_notes(stream, arriving_orders, orders, out, str(tmp_path / "cp"), within="5 days"))
    moved = workflow.transitions(changes, orders)
    posting.spend_stream(stream, orders, f"{out}-spend", str(tmp_path / "cp2")).awaitTermination()
    want = workflow.paid_spend(moved, orders)
    assert sorted(map(tuple, posting.total_spend(spark, f"{out}-spend", orders).collect())) == sorted(map(tuple, want.collect()))
    paid = workflow.into_paid(moved)
    in_time = paid.join(orders.select(F.col("id").alias("order_id"), F.col("created_at").alias("placed")), "order_id").where(
        "created_at <= placed + interval 5 days").drop("placed").where(F.col("order_id") != missing)
    notes = notify.order_paid(in_time, orders)
    assert 0 < notes.count() < notify.order_paid(paid, orders).count()
    assert sorted(map(str, spark.read.parquet(out).select(*notes.columns).collect())) == sorted(map(str, notes.collect()))


def test_top_views_replace_each_other(spark, t, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(part, folder)] for part in in_thirds(t.product_views, ["created_at", "id"])]
    parts[0][0][0].limit(0).write.parquet(folder)
    stream = run.read_files(spark, folder, t.product_views.schema)
    restarted(parts, lambda: run.whole_to(flow.most_viewed(stream, t.products), out, str(tmp_path / "cp")))
    counts = t.product_views.groupBy(F.col("product_id").alias("id")).count().join(t.products.where("is_active").select("id"), "id").collect()
    want = [r.id for r in sorted(counts, key=lambda r: (-r["count"], r.id))[:5]]
    got = run.newest_result(spark, out).collect()
    assert [r.id for r in sorted(got, key=lambda r: (-r.view_count, r.id))] == want
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3


def test_closed_days_and_repeats(spark, t, tmp_path):
    logs = t.activity_logs
    doubled = logs.union(logs.where("id % 4 = 0"))
    stream = arriving(spark, doubled, str(tmp_path / "in"), 3, ["created_at", "id"])
    run.append_to(flow.audit_ingest(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == logs.count()
    again = run.read_files(spark, str(tmp_path / "in/*"), logs.schema, max_files=1)
    run.append_to(flow.daily_orders(again), str(tmp_path / "days"), str(tmp_path / "cp2")).awaitTermination()
    days = {r["day"]: r["order_count"] for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    want = {r["day"]: r["n"] for r in doubled.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert len(days) >= len(want) - 3 and all(want[d] == n for d, n in days.items())


def test_state_is_kept_per_bucket_and_ids_stay_exact(spark, tmp_path):
    big = 2 ** 53 + 1
    opening = spark.range(3000).select(F.col("id").alias("product_id"), F.lit(5).alias("opening_qty")).union(
        spark.createDataFrame([(big, 5), (7000, None)], "product_id long, opening_qty int"))
    schema = "id long, product_id long, type string, qty int, created_at timestamp_ntz"
    moves = spark.range(3000).selectExpr("id", "id as product_id", "'out' as type", "if(id % 2 = 0, 5, 6) as qty", "timestamp_ntz'2024-01-01' as created_at")
    odd = spark.range(3000, 5000).selectExpr("id", "cast(null as long)", "'in'", "1", "timestamp_ntz'2024-01-01'").union(
        spark.createDataFrame([(6000, big, "out", 2), (6001, 7000, "in", 1)], "id long, p long, t string, q int").selectExpr(
            "*", "timestamp_ntz'2024-01-01'"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    moves.union(odd).coalesce(1).write.parquet(folder)
    query = posting.post_stream(run.read_files(spark, folder, spark.createDataFrame([], schema).schema),
                                opening, out, str(tmp_path / "cp"))
    query.awaitTermination()
    # One value of state per bucket: thousands of keys do not ask the state store one by one.
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= posting.BUCKETS
    got = {r.id: (r.product_id, r.qty_after, r.reason) for r in spark.read.parquet(out).collect()}
    assert len(got) == 5002
    assert all(got[i] == ((i, 0, None) if i % 2 == 0 else (i, None, "insufficient_stock")) for i in range(3000))
    assert all(got[i] == (None, None, "product_not_found") for i in range(3000, 5000))
    assert got[6000] == (big, 3, None) and got[6001] == (7000, None, "product_not_found")


def test_payments_are_kept_per_bucket(spark, tmp_path):
    orders = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'paid', if(id % 3 = 1, 'unpaid', null)) as payment_status")
    changes = spark.range(4000).selectExpr("id", "if(id = 3999, null, id) as order_id", "'paid' as payment_status", "timestamp_ntz'2024-01-01' as created_at")
    changes = changes.union(spark.range(4000, 4002).selectExpr("id", "1", "if(id = 4000, 'unpaid', 'paid')", "timestamp_ntz'2024-01-02'"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    changes.coalesce(1).write.parquet(folder)
    query = posting.spend_stream(run.read_files(spark, folder, changes.schema), orders, out, str(tmp_path / "cp"))
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= posting.BUCKETS
    got = sorted((r.order_id, r.id) for r in spark.read.parquet(out).collect())
    assert got == sorted([(i, i) for i in range(3000) if i % 3 == 1] + [(1, 4001)])


def test_state_has_a_partition_per_core_whatever_the_shuffles_have(spark, t, tmp_path):
    changes = spark.range(300).selectExpr("id", "id % 100 as order_id", "if(id < 100, 'unpaid', 'paid') as payment_status", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as created_at")
    orders = spark.range(100).selectExpr("id", "'unpaid' as payment_status", "concat('ORD-', id) as order_number", "timestamp_ntz'2024-01-01' as created_at")
    parts = [str(tmp_path / "in"), str(tmp_path / "placed")]
    changes.where("id < 150").coalesce(1).write.parquet(parts[0])
    orders.coalesce(1).write.parquet(parts[1])
    stream, placed = (run.read_files(spark, path, df.schema) for path, df in zip(parts, (changes, orders)))
    starts = {
        "spend": lambda: posting.spend_stream(stream, orders, str(tmp_path / "spend"), str(tmp_path / "spend-cp")),
        "notes": lambda: posting.payment_notes(stream, placed, orders, str(tmp_path / "notes"), str(tmp_path / "notes-cp"))}

    def started(name):
        query = starts[name]()
        query.awaitTermination()
        return {operator["numShufflePartitions"] for operator in query.lastProgress["stateOperators"]}

    before = spark.conf.get(posting.PARTITIONS)
    few = max(posting.LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)
    try:
        spark.conf.set(posting.PARTITIONS, "3")
        assert started("spend") == {3}
        spark.conf.set(posting.PARTITIONS, "40")
        assert started("notes") == {few}
        assert spark.conf.get(posting.PARTITIONS) == "40"
        changes.where("id >= 150").coalesce(1).write.mode("append").parquet(parts[0])
        assert started("spend") == {3}  # a checkpoint stays as it was begun
    finally:
        spark.conf.set(posting.PARTITIONS, before)
    spent = spark.read.parquet(str(tmp_path / "spend")).collect()
    assert sorted((r.order_id, r.id) for r in spent) == [(i, i + 100) for i in range(100)]
    assert spark.read.parquet(str(tmp_path / "notes")).select("message").distinct().count() == 50

"""Posting, spend, payment notes and stock alerts on streams, with Spark's keyed state.

Products and orders are dealt over a fixed number of buckets by a hash of their id. A bucket's state holds the balances of its products (the
payments of its orders), started from a table of initial values; Spark checkpoints the state with the offsets, so a repeated batch finds what it
found before. A batch asks for and puts back the state once per bucket it touches, not once per key: each such exchange with the state store costs
as much as thousands of rows. Batches are handled in order of arrival; within a batch the order columns decide.

All rows of a bucket in one batch go to one task: `max_files` of `run.read_files` bounds a batch. For a backlog whose single products pass
that, the batch job (`plans.ledger`) cuts products into slices.

Every partition of state costs seconds per batch however few rows it gets (a Python worker, opening and committing its store), with rows or
without. So these streams have as many partitions as the cluster has cores, not as many as the session's shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stockroom.plans import notify
from stockroom.plans.ledger import ORDER
from stockroom.plans.workflow import CHANGE_ORDER
from stockroom.streaming.run import append_to, with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys. A checkpoint belongs to the number it was begun with.
BUCKETS = 512
# Helper columns; Spark hands rows over as named tuples, which know no names that begin with an underscore.
BUCKET = "state_bucket"
NO_KEY = "without_key"
#: Partitions of state at least, where cores are fewer or not there yet.
LEAST_PARTITIONS = 8


def state_partitions(spark: SparkSession) -> int:
    """One per core, so that a batch is one wave of tasks; never more than the session's shuffles have."""
    return min(int(spark.conf.get(PARTITIONS)), max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism))


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that keyed values need, in `state_partitions`. A running stream keeps its
    settings, and a checkpoint the number of partitions it was begun with."""
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PARTITIONS, state_partitions(spark))
    spark.conf.set(PROVIDER, KEYED_STORE)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _in_order(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


class Bucket(StatefulProcessor):
    """What is known of the keys of one bucket, as two arrays in one value of state."""

    key, value, kind = "key", "value", "long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", f"keys array<{self.key_type}>, held array<{self.kind}>")

    def held(self) -> dict:
        kept = self.state.get()
        return {} if kept is None else dict(zip(kept[0], kept[1]))

    def hold(self, held: dict) -> None:
        self.state.update((list(held), list(held.values())))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        # The rows of a bucket may come in several frames.
        self.hold(self.held() | dict(zip(initialState[self.key].tolist(), initialState[self.value].tolist())))

    def close(self) -> None:
        pass


class StockLevel(Bucket):
    """Posts the movements of a bucket of products. State: their balances."""

    key, value, kind = "product_id", "opening_qty", "long"

    def __init__(self, key_type: str, order: Sequence[str], columns: Sequence[str]):
        self.key_type, self.order, self.columns = key_type, list(order), list(columns)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self.order)
        levels, moved = self.held(), False
        booked, before, after, reasons = [], [], [], []
        for product, none, kind, qty in zip(*(frame[c].tolist() for c in ("product_id", NO_KEY, "type", "qty")), strict=True):
            reason, old = None, None if none else levels.get(product)
            level, missing = old, pd.isna(qty)
            if kind not in ("in", "out", "adjustment"):
                reason = "type_invalid"
            elif missing or (kind != "adjustment" and qty <= 0):
                reason = "qty_invalid"
            elif old is None:
                reason = "product_not_found"
            elif kind == "out" and old < qty:
                reason = "insufficient_stock"
            else:
                level = int(qty) if kind == "adjustment" else old + int(qty) if kind == "in" else old - int(qty)
                levels[product], moved = level, True
            posted = reason is None
            reasons.append(reason)
            before.append(old if posted else None)
            after.append(level if posted else None)
            booked.append(None if missing else abs(level - old) if posted and kind == "adjustment" else int(qty))
        if moved:
            self.hold(levels)
        out = frame[self.columns].copy()
        out["qty"] = pd.array(booked, "Int64")
        out["qty_before"], out["qty_after"] = pd.array(before, "Int64"), pd.array(after, "Int64")
        out["reason"] = reasons
        yield out


class PaymentState(Bucket):
    """Finds the changes that take an order into paid. State: the payment status of a bucket of orders."""

    key, value, kind = "order_id", "payment_status", "string"

    def __init__(self, key_type: str):
        self.key_type = key_type

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame, payments, moved, paid = _in_order(rows, CHANGE_ORDER), self.held(), False, []
        for order, new in zip(frame["order_id"].tolist(), frame["payment_status"].tolist()):
            now = payments.get(order)
            new = now if pd.isna(new) else new
            paid.append(new == "paid" and now is not None and now != "paid")
            if new != now and order in payments:  # not an order that nobody knows
                payments[order], moved = new, True
        if moved:
            self.hold(payments)
        yield frame[paid][["order_id", "id", "created_at", "event_time"]]


def posted(movements: DataFrame, opening: DataFrame, order: Sequence[str] = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Every movement of the stream with `qty_before` and `qty_after`, or with the `reason` it is refused for.

    `opening`: product_id, opening_qty; read once, when the stream first starts. Stock never goes below zero. A correction is booked with the
    size of the difference, as in the batch job. `movements` needs `event_time` (`run.with_event_time`).
    """
    fields = {f.name: f.dataType for f in movements.schema.fields}
    kept = [T.StructField(name, T.LongType() if name == "qty" else kind) for name, kind in fields.items()]
    schema = T.StructType([*kept, T.StructField(NO_KEY, T.BooleanType()), T.StructField("qty_before", T.LongType()),
                           T.StructField("qty_after", T.LongType()), T.StructField("reason", T.StringType())])
    key = fields["product_id"]
    # Movements without a product share a bucket with others: a stand-in keeps the ids of that bucket whole numbers.
    stand_in = F.coalesce("product_id", F.lit(0).cast(key))
    rows = movements.withColumn(BUCKET, _bucket_of("product_id", buckets)).withColumn(
        NO_KEY, F.col("product_id").isNull()).withColumn("product_id", stand_in)
    start = opening.where("product_id is not null and opening_qty is not null").select(
        F.col("product_id").cast(key), F.col("opening_qty").cast("bigint"))
    done = rows.groupBy(BUCKET).transformWithStateInPandas(
        StockLevel(key.simpleString(), order, [*fields, NO_KEY]), schema, "Append", "EventTime",
        start.withColumn(BUCKET, _bucket_of("product_id", buckets)).groupBy(BUCKET), eventTimeColumnName="event_time")
    return done.withColumn("product_id", F.when(~F.col(NO_KEY), F.col("product_id"))).drop(NO_KEY)


def post_stream(movements: DataFrame, opening: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ORDER) -> StreamingQuery:
    """Post movements as they arrive and append them to `path`; rows with a `reason` were refused."""
    with keyed_store(opening.sparkSession):
        return append_to(posted(with_event_time(movements), opening, order).drop("event_time"), path, checkpoint)


def alert_stream(movements: DataFrame, opening: DataFrame, products: DataFrame, path: str, checkpoint: str,
                 order: Sequence[str] = ORDER, delay: str = "1 day") -> StreamingQuery:
    """Alerts from the posted balances: two stateful steps in one stream, posting and one alert per movement.

    Only sales that were posted can alert. A movement told twice within `delay` alerts once.
    """
    ledger = posted(with_event_time(movements, delay=delay), opening, order).where(F.col("reason").isNull())
    low = notify.low_sales(ledger).dropDuplicatesWithinWatermark(["product_id", *order])
    with keyed_store(opening.sparkSession):
        return append_to(notify.stock_alert(low, products), path, checkpoint)


def paid_changes(changes: DataFrame, orders: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(order_id, id, created_at, event_time) of the changes into paid. `orders` are those before the feed; changes of others drop out."""
    key = changes.schema["order_id"].dataType
    start = orders.where(F.col("id").isNotNull()).select(F.col("id").cast(key).alias("order_id"), "payment_status")
    schema = T.StructType([changes.schema[c] for c in ("order_id", "id", "created_at", "event_time")])
    rows = changes.where(F.col("order_id").isNotNull()).select(
        *schema.names, "payment_status", _bucket_of("order_id", buckets).alias(BUCKET))
    return rows.groupBy(BUCKET).transformWithStateInPandas(
        PaymentState(key.simpleString()), schema, "Append", "EventTime",
        start.withColumn(BUCKET, _bucket_of("order_id", buckets)).groupBy(BUCKET), eventTimeColumnName="event_time")


def spend_stream(changes: DataFrame, orders: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes into paid to `path`; `total_spend` adds them up."""
    with keyed_store(orders.sparkSession):
        return append_to(paid_changes(with_event_time(changes), orders).drop("event_time"), path, checkpoint)


def total_spend(spark: SparkSession, path: str, orders: DataFrame) -> DataFrame:
    """Lifetime spend per customer over all batches so far."""
    times = spark.read.parquet(path).groupBy("order_id").agg(F.count(F.lit(1)).alias("_times"))
    paid = orders.where(F.col("customer_id").isNotNull()).join(times, orders["id"] == times["order_id"])
    return paid.groupBy("customer_id").agg(F.sum(F.col("total") * F.col("_times")).cast("decimal(25,2)").alias("added_spend"),
                                           F.sum("_times").alias("paid_count"))


def payment_notes(changes: DataFrame, new_orders: DataFrame, orders: DataFrame, path: str, checkpoint: str,
                  within: str = "90 days", delay: str = "1 day") -> StreamingQuery:
    """A note for every payment: the stream of changes meets the stream of orders.

    Both sides are kept until the watermark says that no partner can come: an order waits `within` for its payments. A payment
    later than that, one whose order never arrives, and rows later than `delay` behind their stream give no note.
    """
    paid = paid_changes(with_event_time(changes, delay=delay), orders).withColumnRenamed("event_time", "paid_time")
    placed = with_event_time(new_orders, delay=delay).select(F.col("id").alias("placed_id"), "order_number", F.col("event_time").alias("placed_time"))
    met = paid.join(placed, F.expr(
        f"order_id = placed_id and paid_time >= placed_time and paid_time <= placed_time + interval {within}"))
    with keyed_store(orders.sparkSession):
        return append_to(notify.paid_notes(met), path, checkpoint)

"""Counts over streams: days, request rates, views, expired sessions. All windows and aggregates are built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.functions.text import shorten
from stockroom.plans.stock import qty_of
from stockroom.streaming.run import with_event_time


def _day() -> Column:
    return F.window("event_time", "1 day").alias("w")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date(F.col("w.start"))).drop("w")


def daily_orders(orders: DataFrame) -> DataFrame:
    """Orders per day; days without orders are filled in by the reader of the result."""
    return _named(with_event_time(orders).groupBy(_day()).agg(F.count(F.lit(1)).alias("order_count")))


def daily_flow(transactions: DataFrame) -> DataFrame:
    daily = with_event_time(transactions).groupBy(_day()).agg(qty_of("in").alias("stock_in"), qty_of("out").alias("stock_out"))
    return _named(daily).withColumn("stock_in", F.coalesce("stock_in", F.lit(0))).withColumn(
        "stock_out", F.coalesce("stock_out", F.lit(0)))


def request_rates(requests: DataFrame, key: str = "ip_address", limit: int = V.REQUESTS_PER_15_MIN) -> DataFrame:
    """Keys above the limit in a clock-aligned quarter of an hour. Counts are combined before the shuffle,
    so one busy key costs one row per task."""
    counted = (with_event_time(requests, delay="15 minutes").groupBy(key, F.window("event_time", "15 minutes").alias("w"))
               .agg(F.count(F.lit(1)).alias("request_count")).where(F.col("request_count") > limit))
    return counted.select(key, F.col("w.start").alias("window_start"), "request_count")


def view_counters(views: DataFrame, products: DataFrame) -> DataFrame:
    """Running views per published product (update mode). A view of any other product does not count."""
    shown = products.where(P.published()).select(F.col("id").alias("product_id"))
    return views.join(shown, "product_id", "left_semi").groupBy("product_id").agg(F.count(F.lit(1)).alias("view_count"))


def most_viewed(views: DataFrame, products: DataFrame, count: int = 5, label_chars: int = 18) -> DataFrame:
    """The products with the most views so far (complete mode: the ordered result of every batch replaces the one before).

    Views are counted per product before names are looked up; ties go to the smaller id.
    """
    shown = products.where("is_active").select("id", "name", "slug")
    counted = views.groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("view_count"))
    ranked = counted.join(shown, "id").orderBy(F.desc("view_count"), F.asc("id")).limit(count)
    return ranked.select("id", "name", "slug", "view_count", shorten(F.col("name"), label_chars).alias("label"))


def failed_logins(attempts: DataFrame, key: str = "ip_address", limit: int = V.FAILED_LOGINS_PER_15_MIN) -> DataFrame:
    """Keys above the limit of failed sign-ins in a quarter of an hour. `attempts` has a flag `success`."""
    return request_rates(attempts.where(~F.col("success")), key, limit)


def expired_sessions(sessions: DataFrame, hours: int = V.SESSION_HOURS) -> DataFrame:
    """Sessions whose end has passed, in append mode.

    Expiry is the event time and the session length the watermark delay, so the watermark is the latest
    login seen: a session comes out once logins have moved past its end.
    """
    timed = with_event_time(sessions.where("is_active"), "expires_at", f"{hours} hours")
    ended = timed.groupBy(F.window("event_time", "1 minute").alias("w"), "id", "user_id").agg(F.max("expires_at").alias("expired_at"))
    return ended.select("id", "user_id", "expired_at")


def audit_ingest(logs: DataFrame) -> DataFrame:
    """Log rows without repeats; state is dropped with the watermark."""
    return with_event_time(logs).dropDuplicatesWithinWatermark(["id"]).drop("event_time")

"""Named row conditions. The business uses several meanings of "low", "open" and "new": each has a name."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom import fixed_values as V


def low_stock(stock: Column) -> Column:
    """Low but not out: the warehouse dashboard and the product list filter."""
    return (stock > 0) & (stock <= V.LOW_STOCK)


def low_or_out(stock: Column) -> Column:
    """Low including zero: the executive dashboard."""
    return stock <= V.LOW_STOCK


def on_watch_list(stock: Column) -> Column:
    return stock <= V.WATCH_STOCK


def out_of_stock(stock: Column) -> Column:
    return stock == 0


def published() -> Column:
    return (F.col("publish_status") == "published") & F.col("is_active")


def in_work_queue() -> Column:
    return F.col("publish_status").isin(V.QUEUE_STATUSES)


def new_for_kpi() -> Column:
    return F.col("publish_status").isin(V.NEW_KPI_STATUSES)


def open_order() -> Column:
    return F.col("status").isin(V.OPEN_ORDER_STATUSES)


def deducted(status: Column) -> Column:
    return status.isin(V.DEDUCTED_STATUSES)


def on_day(ts: Column, day: dt.date) -> Column:
    """Half-open range on the bare column, so it reaches the Parquet reader as a range filter."""
    start = dt.datetime.combine(day, dt.time())
    return _between(ts, start, start + dt.timedelta(days=1))


def in_month(ts: Column, day: dt.date) -> Column:
    start = dt.datetime(day.year, day.month, 1)
    end = dt.datetime(day.year + day.month // 12, day.month % 12 + 1, 1)
    return _between(ts, start, end)


def _between(ts: Column, start: dt.datetime, end: dt.datetime) -> Column:
    return (ts >= time_literal(start)) & (ts < time_literal(end))


def time_literal(value: dt.datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")

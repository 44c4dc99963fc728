"""Display labels, badges and date texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom import fixed_values as V


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(text) for pair in pairs.items() for text in pair])


def status_label(value: Column) -> Column:
    """Display text of a status, role or transaction type; unknown values show as they are."""
    return F.coalesce(F.element_at(_lookup(V.STATUS_LABELS), value), value)


def stock_badge(stock: Column) -> Column:
    return F.when(stock == 0, V.BADGE_SOLD_OUT).when(stock <= V.LOW_STOCK, V.BADGE_LIMITED)


def list_colour(stock: Column) -> Column:
    return F.when(stock <= V.LOW_STOCK, "danger").when(stock <= V.AMPLE_STOCK, "warning").otherwise("success")


def summary_colour(stock: Column) -> Column:
    return F.when(stock == 0, "danger").when(stock <= V.WATCH_STOCK, "warning").otherwise("success")


def signed_qty(kind: Column, qty: Column) -> Column:
    sign = F.when(kind == "in", "+").when(kind == "out", "-").otherwise("±")
    return F.concat(sign, qty.cast("string"))


def day_label(day: Column) -> Column:
    return F.date_format(day, "dd/MM")


def date_label(ts: Column) -> Column:
    """'05 Agu 2026'."""
    months = F.array(*[F.lit(name) for name in V.MONTHS_SHORT])
    return F.concat_ws(" ", F.date_format(ts, "dd"), F.element_at(months, F.month(ts)), F.date_format(ts, "yyyy"))


def date_time_label(ts: Column) -> Column:
    """'05 Agu 2026, 14.30'."""
    return F.concat(date_label(ts), F.lit(", "), F.date_format(ts, "HH.mm"))


def order_number(year: Column, seq: Column) -> Column:
    """ORD-2026-0007; numbers above 9999 are not cut."""
    digits = seq.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))
    return F.concat_ws("-", F.lit(V.ORDER_NUMBER_PREFIX), year.cast("string"), padded)


def number_of(order_number_column: Column) -> Column:
    """Numeric suffix of an order number, null when it is not a number."""
    return F.substring_index(order_number_column, "-", -1).try_cast("bigint")

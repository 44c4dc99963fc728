"""Money columns and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.schemas import MONEY


def money(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(MONEY)


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast(MONEY))


def order_total(subtotal: Column, discount: Column, shipping: Column) -> Column:
    return money(at_least_zero(money(subtotal - discount + shipping)))


def rupiah(value: Column) -> Column:
    """1234567.50 -> 'Rp 1.234.567,5'; null and zero -> 'Rp 0'."""
    shown = F.translate(F.call_function("format_number", value, F.lit("#,##0.###")), ",.", ".,")
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit("Rp 0")).otherwise(F.concat(F.lit("Rp "), shown))


def outstanding(total: Column, paid: Column) -> Column:
    """What is still to pay, null when nothing is."""
    rest = money(total - paid)
    return F.when(rest > 0, rest)


def backfilled_price_label(label: Column, sell_price: Column) -> Column:
    """Default or empty labels get 'Mulai Rp X' once a selling price is known."""
    empty = (F.coalesce(label, F.lit("")).isin("", V.DEFAULT_PRICE_LABEL)
             | F.startswith(label, F.lit(V.PRICE_LABEL_PREFIX + "Rp 0")))
    return F.when(empty & (sell_price > 0), F.concat(F.lit(V.PRICE_LABEL_PREFIX), rupiah(sell_price))).otherwise(label)

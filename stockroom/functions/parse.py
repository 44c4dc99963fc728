"""Lenient parsing of loosely typed feed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom.schemas import MONEY

# Longest numeric prefix of a text, as the feeds' producers read numbers.
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_EMPTY_OR_ZERO = r"^(|\s*[+-]?(?:0+\.?0*|\.0+)(?:[eE][+-]?[0-9]+)?\s*)$"
_NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def _prefix(text: Column, pattern: str, kind) -> Column:
    found = F.regexp_extract(text.cast("string"), pattern, 1)
    return F.when(found != "", found.try_cast(kind))


def int_prefix(text: Column) -> Column:
    """'12abc' -> 12, 'abc' -> null."""
    return _prefix(text, _INT_PREFIX, "bigint")


def money_prefix(text: Column) -> Column:
    """'12.5 each' -> 12.50, 'abc' -> null."""
    return _prefix(text, _NUMBER_PREFIX, MONEY)


def price_prefix(text: Column) -> Column:
    """As `money_prefix`, with six decimals: a price is multiplied first and rounded to cents after that."""
    return _prefix(text, _NUMBER_PREFIX, "decimal(20,6)")


def int_or_zero(text: Column) -> Column:
    return F.coalesce(int_prefix(text), F.lit(0))


def money_or_zero(text: Column) -> Column:
    return F.coalesce(money_prefix(text), F.lit(0).cast(MONEY))


def price_or_zero(text: Column) -> Column:
    return F.coalesce(price_prefix(text), F.lit(0).cast("decimal(20,6)"))


def is_truthy_number(text: Column) -> Column:
    """False for null, empty and numeric zero; feed values are numbers, or text where not numeric."""
    # A pattern, not a cast: a failing cast costs an exception per row.
    return F.coalesce(~text.cast("string").rlike(_EMPTY_OR_ZERO), F.lit(False))


def flag(text: Column) -> Column:
    """1 and 'true' are true, everything else (null too) is false."""
    return F.coalesce(text.cast("string").isin("1", "true"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First column that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[blank_to_null(c) for c in columns[:-1]], columns[-1])

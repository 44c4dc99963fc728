"""Optional filters, search and date ranges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions import predicates as P
from stockroom.functions.text import contains_text, contains_text_ascii


def apply_filters(df: DataFrame, **equal) -> DataFrame:
    """Keep rows equal to every value given; None and '' mean "not asked for"."""
    for name, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(name) == F.lit(value))
    return df


def search(df: DataFrame, term: str | None, columns: Sequence[str], ascii_only: bool = False) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case (and accents unless `ascii_only`)."""
    if not term:
        return df
    match = contains_text_ascii if ascii_only else contains_text
    return df.where(reduce(Column.__or__, [F.coalesce(match(F.col(c), term), F.lit(False)) for c in columns]))


def date_between(df: DataFrame, column: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Both days included; a range on the bare column, so that the file reader can skip row groups."""
    if start is not None:
        df = df.where(F.col(column) >= P.time_literal(dt.datetime.combine(start, dt.time())))
    if end is not None:
        after = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
        df = df.where(F.col(column) < P.time_literal(after))
    return df

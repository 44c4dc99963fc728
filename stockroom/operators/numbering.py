"""Row numbers and running sums over a whole table without bringing it into one task.

Rows are dealt to ranges of the order, each range is numbered on its own, and what the ranges before it hold is added. Only one
row per range passes through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import written

RANGE = "_range"


def in_ranges(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """`df`, written once, with the number of the range of `order` that each row fell into. Equal rows share a range."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def before_ranges(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per range, the total of each of `sums` over all ranges before it. One row per range."""
    totals = ranged.groupBy(RANGE).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums])


def numbered(df: DataFrame, order: Sequence[Column | str], number: str = "row_number", sums: dict[str, Column] | None = None,
             ranges: int | None = None, keep_range: bool = False) -> DataFrame:
    """`df` with gapless numbers from 1 in `order`, and for each of `sums` the running total up to and with the row.

    `order` should be total; rows that tie are numbered in any order among themselves. An empty table stays empty. `keep_range` leaves
    the number of each row's range in the column `RANGE`.
    """
    parts = {number: F.lit(1).cast("bigint"), **(sums or {})}
    ranged = in_ranges(df, order, ranges)
    # One row per range: never more than there are shuffle partitions.
    carried = F.broadcast(before_ranges(ranged, parts).withColumnsRenamed({name: f"_before_{name}" for name in parts}))
    here = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({name: F.sum(value).over(here) for name, value in parts.items()})
    return (local.join(carried, RANGE)
            .withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in parts})
            .drop(*[f"_before_{name}" for name in parts], *([] if keep_range else [RANGE])))

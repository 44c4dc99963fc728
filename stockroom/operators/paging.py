"""Pages: numbered, keyset, saved with an index of their first keys, and page metadata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.operators.numbering import RANGE, numbered


def clamp(page: int | None, limit: int | None, max_limit: int = V.MAX_PAGE, default: int = V.PAGE_LIMIT) -> tuple[int, int]:
    """Page at least 1, limit between 1 and `max_limit`; zero or missing values take the defaults."""
    return max(1, page or 1), min(max(1, limit or default), max_limit)


def page_of(df: DataFrame, order: Sequence[Column], page: int | None = 1, limit: int | None = None,
            max_limit: int = V.MAX_PAGE) -> DataFrame:
    """One numbered page. `order` must end in a unique column."""
    page, limit = clamp(page, limit, max_limit)
    start = (page - 1) * limit
    ordered = df.orderBy(*order)
    return (ordered.offset(start) if start else ordered).limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence | None, limit: int | None = None,
               max_limit: int = V.MAX_PAGE) -> DataFrame:
    """The page behind a given row: cost does not grow with depth.

    `order` is (column, ascending) pairs ending in a unique column, `last` the values of the last row seen.
    """
    _, limit = clamp(1, limit, max_limit)
    if last is not None:
        df = df.where(_beyond(order, last, False))
    return df.orderBy(*[F.asc(n) if up else F.desc(n) for n, up in order]).limit(limit)


def _beyond(order: Sequence[tuple[str, bool]], key: Sequence, included: bool) -> Column:
    """Rows behind `key` in `order` (and, with `included`, at it)."""
    options = []
    for i, (name, ascending) in enumerate(order):
        same = [F.col(n) == F.lit(v) for (n, _), v in zip(order[:i], key, strict=False)]
        beyond = F.col(name) > F.lit(key[i]) if ascending else F.col(name) < F.lit(key[i])
        options.append(reduce(Column.__and__, [*same, beyond]))
    if included:
        options.append(reduce(Column.__and__, [F.col(n) == F.lit(v) for (n, _), v in zip(order, key, strict=True)]))
    return reduce(Column.__or__, options)


def save_pages(df: DataFrame, order: Sequence[tuple[str, bool]], path: str, limit: int | None = None, max_limit: int = V.MAX_PAGE,
               ranges: int | None = None) -> None:
    """Save `df` in `order` below `path`, with the first key of every page beside it.

    `order` is (column, ascending) pairs ending in a unique column, none of them null. One pass numbers the rows range by range
    (`operators.numbering`); the files are sorted, so a reader skips all row groups outside a page's keys.
    """
    _, limit = clamp(1, limit, max_limit)
    by = [F.asc(n) if up else F.desc(n) for n, up in order]
    rows = numbered(df, by, "_number", ranges=ranges, keep_range=True)
    rows.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")  # an empty table has no other file
    starts = _saved_rows(df.sparkSession, path).where((F.col("_number") - 1) % limit == 0)
    starts = starts.select((F.expr(f"(_number - 1) div {limit}") + 1).alias("page"), RANGE, *[n for n, _ in order])
    starts.sortWithinPartitions("page").write.mode("overwrite").parquet(f"{path}/pages")


def _saved_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def saved_page(spark: SparkSession, order: Sequence[tuple[str, bool]], path: str, page: int | None = 1) -> DataFrame:
    """One page of what `save_pages` saved: the rows from its first key up to the next page's. Every page costs the same, however deep.

    A page past the end is empty.
    """
    page = max(1, page or 1)
    keys = {r["page"]: r for r in spark.read.parquet(f"{path}/pages").where(F.col("page").isin(page, page + 1)).collect()}
    rows = _saved_rows(spark, path)
    if page not in keys:
        return rows.limit(0).drop("_number", RANGE)
    names = [n for n, _ in order]
    first, behind = keys[page], keys.get(page + 1)
    # The leading column alone is what files are skipped by, so it is asked for by itself; so are the ranges.
    lead, up = order[0]
    found = rows.where(F.col(RANGE) >= first[RANGE]).where(F.col(lead) >= first[lead] if up else F.col(lead) <= first[lead])
    found = found.where(_beyond(order, [first[n] for n in names], True))
    if behind is not None:
        found = found.where(F.col(RANGE) <= behind[RANGE]).where(F.col(lead) <= behind[lead] if up else F.col(lead) >= behind[lead])
        found = found.where(~_beyond(order, [behind[n] for n in names], True))
    return found.orderBy("_number").drop("_number", RANGE)


def page_info(df: DataFrame, page: int | None = 1, limit: int | None = None, max_limit: int = V.MAX_PAGE) -> DataFrame:
    """total, page, limit, total_pages and the shown range, in one row."""
    page, limit = clamp(page, limit, max_limit)
    total = F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        total, F.lit(page).cast("bigint").alias("page"), F.lit(limit).cast("bigint").alias("limit"),
        F.ceil(total / limit).cast("bigint").alias("total_pages"),
        F.lit((page - 1) * limit + 1).cast("bigint").alias("shown_from"),
        F.least(F.lit(page * limit).cast("bigint"), total).alias("shown_to"))

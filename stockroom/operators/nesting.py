"""Parent rows with ordered arrays of children, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.keyed import KeyedOrder

PART_ROWS = 10_000


def child_arrays(children: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str,
                 part_rows: int = PART_ROWS, **keyed) -> DataFrame:
    """`key`, `part_no` (from 1) and `name`: the children in order, each with its `row_no`.

    A key with more than `part_rows` children continues in further parts, so no task and no row ever
    holds an unbounded group. Keys below that, which is nearly all, have exactly one part.
    """
    numbered = KeyedOrder(children.where(F.col(key).isNotNull()), [key], order, **keyed).row_number("row_no").result()
    entry = F.struct("row_no", *columns)
    return (numbered.withColumn("part_no", (F.floor((F.col("row_no") - 1) / part_rows) + 1).cast("bigint"))
            .groupBy(key, "part_no").agg(F.sort_array(F.collect_list(entry)).alias(name)))


def with_children(parents: DataFrame, key: str, arrays: DataFrame, child_key: str, name: str) -> DataFrame:
    """Parents joined with their child parts; parents without children get part 1 and an empty array."""
    renamed = arrays.withColumnRenamed(child_key, "_parent")
    joined = parents.join(renamed, F.col(key) == F.col("_parent"), "left").drop("_parent")
    empty = F.array().cast(arrays.schema[name].dataType)
    return (joined.withColumn(name, F.coalesce(F.col(name), empty))
            .withColumn("part_no", F.coalesce(F.col("part_no"), F.lit(1).cast("bigint"))))

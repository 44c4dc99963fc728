"""Applying change feeds to tables: patches, upserts, child replacement, deletes.

Each job takes whole tables and returns whole tables; write the result to a new path and switch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.schemas import FOREIGN_KEYS


def newest(feed: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; a max over structs, so it is combined before the shuffle."""
    rest = [c for c in feed.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return feed.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def apply_patch(base: DataFrame, patches: DataFrame, key: str, order: Sequence[str],
                columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Set the non-null patch values, the latest one per column; unknown keys are rejected."""
    def latest(column: str) -> Column:
        given = F.col(column).isNotNull()
        return F.max_by(F.when(given, F.col(column)), F.when(given, F.struct(*order))).alias(f"_new_{column}")

    reduced = patches.groupBy(key).agg(*[latest(c) for c in columns])
    joined = base.join(reduced, key, "left")
    applied = joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
    rejects = patches.join(base.select(key), key, "left_anti").withColumn("reason", F.lit("not_found"))
    return applied, rejects


def replace_children(base: DataFrame, replaced_parents: DataFrame, parent_key: str, new_rows: DataFrame) -> DataFrame:
    """Drop all children of the given parents and put `new_rows` in their place."""
    kept = base.join(replaced_parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.unionByName(new_rows)


def delete_cascade(tables: Mapping[str, DataFrame], table: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of `table` by `id` and follow its foreign keys: children go, or lose the reference."""
    result = dict(tables)
    pending = [(table, deleted.select("id").distinct())]
    while pending:
        parent, ids = pending.pop(0)
        if parent in result:
            result[parent] = result[parent].join(ids, "id", "left_anti")
        for child, links in FOREIGN_KEYS.items():
            for column, target, rule in links:
                if target != parent or child not in result:
                    continue
                gone = ids.withColumnRenamed("id", column)
                if rule == "null":
                    result[child] = nullify(result[child], column, ids)
                elif "id" in result[child].columns and any(
                        t == child for links2 in FOREIGN_KEYS.values() for _, t, _ in links2):
                    pending.append((child, result[child].join(gone, column, "left_semi").select("id")))
                else:
                    result[child] = result[child].join(gone, column, "left_anti")
    return result


def nullify(child: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Clear `column` where it points to a deleted `id`."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    return (child.join(gone, F.col(column) == F.col("_gone"), "left")
            .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
            .select(*child.columns))

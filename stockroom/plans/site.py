"""Site content: settings, testimonials, contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import text as X
from stockroom.operators.keyed import KeyedOrder


def public_settings(settings: DataFrame, group: str | None = None) -> DataFrame:
    shown = settings.where(F.col("key").isin(V.PUBLIC_SETTINGS))
    return shown.where(F.col("group_name") == group) if group else shown


def settings_map(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with one map. `keys` is a fixed list, so the map is small whatever the table holds."""
    pairs = settings.where(F.col("key").isin(list(keys))).groupBy("key").agg(F.max("value").alias("value"))
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def settings_groups(settings: DataFrame, **keyed) -> DataFrame:
    """Admin view: every setting with its group and its position there, in display order."""
    named = settings.withColumn("group_name", F.coalesce("group_name", F.lit("")))
    return KeyedOrder(named, ["group_name"], ["id"], **keyed).row_number("position").result().select(
        "group_name", "position", "key", "value", "type")


def typed_settings(settings: DataFrame) -> DataFrame:
    """Value columns by type tag."""
    value = F.col("value")
    return settings.select(
        "key", "type", "group_name", value.alias("text_value"),
        F.when(F.col("type") == "number", value.try_cast("double")).alias("number_value"),
        F.when(F.col("type") == "boolean", value.isin("1", "true")).alias("boolean_value"))


def latest_settings(feed: DataFrame) -> DataFrame:
    """The last value written per key."""
    return feed.groupBy("key").agg(
        F.max_by("value", F.struct("created_at", "id")).alias("value"), F.max("created_at").alias("updated_at"),
        F.count(F.lit(1)).alias("write_count"))


def upsert_settings(settings: DataFrame, feed: DataFrame, insert_missing: bool) -> tuple[DataFrame, DataFrame]:
    """Bulk saves only update known keys (`insert_missing=False`, nulls skipped); single-key saves also
    insert, as text in group general, and take a missing value as ''. Keys over 100 characters are refused."""
    usable = F.length("key").between(1, V.MAX_SETTING_KEY)
    valid = feed.where(F.coalesce(usable, F.lit(False)))
    if insert_missing:
        valid = valid.withColumn("value", F.coalesce("value", F.lit("")))
    else:
        valid = valid.where(F.col("value").isNotNull())
    last = valid.groupBy("key").agg(F.max_by("value", F.struct("created_at", "id")).alias("_new"))
    updated = settings.join(last, "key", "left").withColumn("value", F.coalesce("_new", "value")).select(*settings.columns)
    missing = last.join(settings.select("key"), "key", "left_anti")
    bad = feed.where(~F.coalesce(usable, F.lit(False))).withColumn("reason", F.lit("key_invalid"))
    if not insert_missing:
        unknown = valid.join(settings.select("key"), "key", "left_anti").withColumn("reason", F.lit("unknown_key"))
        return updated, bad.unionByName(unknown)
    added = missing.select("key", F.col("_new").alias("value"), F.lit("text").alias("type"),
                           F.lit("general").alias("group_name"))
    return updated.unionByName(added, allowMissingColumns=True), bad


def testimonials(table: DataFrame, active_only: bool = True) -> DataFrame:
    shown = table.where("is_active") if active_only else table
    return shown.withColumn("initial", X.initial(F.col("name"))).withColumn("stars", X.stars(F.col("rating")))


def contacts(table: DataFrame, is_read: bool | None = None) -> DataFrame:
    return table if is_read is None else table.where(F.col("is_read") == F.lit(is_read))


def recent_contacts(table: DataFrame, count: int = 5) -> DataFrame:
    return table.orderBy(F.desc("created_at"), F.desc("id")).limit(count).select(
        "id", "name", "subject", "created_at", "is_read")


def mark_contacts_read(table: DataFrame, reads: DataFrame) -> DataFrame:
    seen = reads.select(F.col("contact_id").alias("id"), F.lit(True).alias("_seen")).distinct()
    return (table.join(seen, "id", "left")
            .withColumn("is_read", F.col("is_read") | F.coalesce("_seen", F.lit(False))).select(*table.columns))


def service_info(services: DataFrame) -> DataFrame:
    """The pipe list of a service as numbered label and text rows."""
    return (services.select("id", F.posexplode(X.label_pairs(F.col("info"))).alias("at", "pair"))
            .select("id", (F.col("at") + 1).cast("bigint").alias("position"),
                    F.col("pair.label").alias("label"), F.col("pair.text").alias("text")))

"""Backfill from the first table layout to the present one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.predicates import time_literal


def migrate_users(users: DataFrame) -> DataFrame:
    """Role 'admin' becomes 'admin_website'; the account 'admin' becomes superadmin."""
    role = (F.when(F.col("username") == "admin", "superadmin")
            .when(F.col("role") == "admin", "admin_website").otherwise(F.col("role")))
    return users.withColumn("role", role)


def migrate_products(products: DataFrame, now: dt.datetime) -> DataFrame:
    """The active flag becomes a publish status."""
    active = F.col("is_active")
    status = F.when(active, "published").when(~active, "hidden").otherwise("new")
    return (products.withColumn("publish_status", status)
            .withColumn("published_at", F.when(active, time_literal(now))))

"""Customer and supplier lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.filters import search
from stockroom.operators.keyed import first_per_key


def customer_rollup(customers: DataFrame, orders: DataFrame, term: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Orders and their value per customer over all statuses. This is not the stored lifetime spend,
    which counts payments (`plans.workflow.paid_spend`)."""
    totals = (orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
              .agg(F.count(F.lit(1)).alias("total_orders_count"), F.sum("total").alias("total_spend_actual"))
              .withColumnRenamed("customer_id", "id"))
    found = search(customers, term, ["name", "code", "phone", "email"], ascii_only)
    return (found.join(totals, "id", "left")
            .withColumn("total_orders_count", F.coalesce("total_orders_count", F.lit(0)))
            .withColumn("total_spend_actual", F.coalesce("total_spend_actual", F.lit(0)).cast("decimal(25,2)")))


def last_orders(orders: DataFrame, count: int = 10) -> DataFrame:
    """The last `count` orders of every customer, newest first."""
    placed = orders.where(F.col("customer_id").isNotNull())
    return first_per_key(placed, ["customer_id"], [F.desc("created_at"), F.desc("id")], count, rank="order_rank").select(
        "customer_id", F.col("order_rank").cast("bigint").alias("order_rank"), "id", "order_number", "status", "total",
        "created_at")


def customer_documents(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer with the array of the last ten orders (the array cannot grow beyond ten)."""
    recent = last_orders(orders).groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct(
        "order_rank", "id", "order_number", "status", "total", "created_at"))).alias("orders"))
    joined = customers.join(recent.withColumnRenamed("customer_id", "id"), "id", "left")
    return joined.withColumn("orders", F.coalesce("orders", F.array().cast(recent.schema["orders"].dataType)))


def supplier_list(suppliers: DataFrame, term: str | None = None, ascii_only: bool = False) -> DataFrame:
    return search(suppliers, term, ["name", "code", "contact_name"], ascii_only)

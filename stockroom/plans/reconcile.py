"""Reports on figures that should agree and may not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.keyed import KeyedOrder


def order_differences(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose subtotal is not the sum of their items."""
    sums = items.groupBy("order_id").agg(F.sum("subtotal").cast("decimal(25,2)").alias("_sum"))
    joined = orders.join(sums, orders["id"] == sums["order_id"], "left")
    item_sum = F.coalesce("_sum", F.lit(0).cast("decimal(25,2)"))
    return joined.where(F.col("subtotal") != item_sum).select(
        "id", "order_number", "subtotal", item_sum.alias("item_sum"),
        (F.col("subtotal") - item_sum).cast("decimal(26,2)").alias("difference"))


def stock_differences(products: DataFrame, transactions: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Products whose stock is not the balance of their last transaction."""
    last = transactions.groupBy(F.col("product_id").alias("id")).agg(F.max_by("qty_after", F.struct(*order)).alias("ledger_qty"))
    return products.join(last, "id").where(F.col("warehouse_stock") != F.col("ledger_qty")).select(
        "id", "sku", "warehouse_stock", "ledger_qty")


def broken_links(transactions: DataFrame, order: Sequence[str] = ("created_at", "id"), **keyed) -> DataFrame:
    """Transactions that do not start where the one before ended."""
    linked = KeyedOrder(transactions, ["product_id"], order, **keyed).previous(F.col("qty_after"), "previous_after").result()
    return linked.where(F.col("previous_after") != F.col("qty_before"))


def price_differences(transactions: DataFrame) -> DataFrame:
    """Transactions whose total is not quantity times price."""
    worth = (F.col("qty") * F.col("unit_price")).cast("decimal(25,2)")
    return transactions.where(worth != F.col("total_price")).withColumn("computed_total", worth)


def restored_after_delete(orders: DataFrame, transactions: DataFrame) -> DataFrame:
    """Stock still held by orders that are gone: deleting an order gives nothing back."""
    held = transactions.where(F.col("order_id").isNotNull()).groupBy("order_id", "product_id").agg(
        F.sum(F.when(F.col("type") == "out", F.col("qty").cast("bigint")).otherwise(-F.col("qty").cast("bigint"))).alias("held_qty"))
    return held.where(F.col("held_qty") > 0).join(orders.select(F.col("id").alias("order_id")), "order_id", "left_anti")

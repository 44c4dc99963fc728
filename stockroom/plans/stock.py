"""Stock reports: in and out totals, flow, watch list, transaction list, exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.functions.labels import day_label, signed_qty, status_label
from stockroom.functions.money import money
from stockroom.operators.filters import apply_filters, date_between, search
from stockroom.plans.catalog import with_user_name
from stockroom.plans.orders import day_spine
from stockroom.plans.site import settings_map
from stockroom.sources.sinks import write_report


def qty_of(kind: str) -> Column:
    return F.sum(F.when(F.col("type") == kind, F.col("qty").cast("bigint")))


def stock_summary(products: DataFrame, categories: DataFrame, transactions: DataFrame) -> DataFrame:
    """Quantities received and issued per product; corrections do not count.

    Transactions are summed per product before any join, so the join meets one row per product.
    """
    totals = (transactions.where(F.col("type").isin("in", "out")).groupBy("product_id")
              .agg(qty_of("in").alias("total_in"), qty_of("out").alias("total_out"))
              .withColumnRenamed("product_id", "id"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return products.join(totals, "id", "left").join(names, "category_id", "left").select(
        "id", "sku", "name", "warehouse_stock", "unit", "publish_status", "category_name",
        F.coalesce("total_in", F.lit(0)).alias("total_in"), F.coalesce("total_out", F.lit(0)).alias("total_out"))


def stock_value() -> Column:
    return F.col("warehouse_stock") * F.col("cost_price")


def inventory_value(products: DataFrame) -> DataFrame:
    return products.agg(F.coalesce(F.sum(stock_value()), F.lit(0)).cast("decimal(25,2)").alias("inventory_value"))


def stock_flow(transactions: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Received and issued quantity per day, days without movement included."""
    daily = (date_between(transactions, "created_at", as_of - dt.timedelta(days=days - 1), as_of)
             .groupBy(F.to_date("created_at").alias("day"))
             .agg(qty_of("in").alias("stock_in"), qty_of("out").alias("stock_out")))
    return day_spine(transactions, as_of, days).join(daily, "day", "left").select(
        "day", day_label(F.col("day")).alias("label"), F.coalesce("stock_in", F.lit(0)).alias("stock_in"),
        F.coalesce("stock_out", F.lit(0)).alias("stock_out"))


def watch_list(products: DataFrame, categories: DataFrame, count: int = 10) -> DataFrame:
    """The products closest to running out."""
    low = (products.where(P.on_watch_list(F.col("warehouse_stock")))
           .orderBy(F.asc("warehouse_stock"), F.asc("id")).limit(count))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return low.join(names, "category_id", "left").select("id", "name", "sku", "warehouse_stock", "unit", "category_name")


def transactions_report(transactions: DataFrame, products: DataFrame, suppliers: DataFrame, users: DataFrame,
                        kind: str | None = None, product_id: int | None = None, date_from: dt.date | None = None,
                        date_to: dt.date | None = None, term: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Filtered transactions with product, supplier and user names."""
    found = apply_filters(transactions, type=kind, product_id=product_id)
    found = date_between(found, "created_at", date_from, date_to)
    about = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku", "unit")
    found = search(found.join(about, "product_id", "left"), term, ["product_name", "sku", "reference_no"], ascii_only)
    sources = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    found = with_user_name(found.join(sources, "supplier_id", "left"), users, "created_by", "created_by_name")
    return (found.withColumn("signed_qty", signed_qty(F.col("type"), F.col("qty")))
            .withColumn("type_label", status_label(F.col("type"))))


def recent_transactions(transactions: DataFrame, products: DataFrame, users: DataFrame, order: list[Column] | None = None,
                        count: int = 10) -> DataFrame:
    last = transactions.orderBy(*(order or [F.desc("created_at"), F.desc("id")])).limit(count)
    about = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku")
    return with_user_name(last.join(about, "product_id", "left"), users, "created_by", "created_by_name")


def stock_report(products: DataFrame, categories: DataFrame, term: str | None = None, ascii_only: bool = False) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return search(products, term, ["name", "sku"], ascii_only).join(names, "category_id", "left").select(
        "id", "sku", "name", "warehouse_stock", "unit", "cost_price", "sell_price", "publish_status", "category_name",
        money(stock_value()).alias("stock_value"))


def report_order(sort: str | None = None, direction: str | None = None) -> list[Column]:
    """Allowed sort fields only; anything else sorts by stock. The publish status sorts in workflow order."""
    field = sort if sort in V.SORT_FIELDS else "warehouse_stock"
    column = F.col(field)
    if field == "publish_status":
        column = F.array_position(F.array(*[F.lit(s) for s in V.PUBLISH_STATUSES]), column)
    down = (direction or "").upper() == "DESC"
    return [column.desc() if down else column.asc(), F.asc("name"), F.asc("id")]


def company_header(settings: DataFrame) -> DataFrame:
    return settings_map(settings, V.REPORT_SETTINGS)


def export_stock_report(products: DataFrame, categories: DataFrame, settings: DataFrame, path: str,
                        term: str | None = None, sort: str | None = None, direction: str | None = None,
                        form: str = "parquet") -> None:
    """Every row of the report in order, and a header with the total value and the company data."""
    rows = stock_report(products, categories, term)
    header = inventory_value(products).withColumn("company", F.to_json(company_header(settings).scalar()))
    write_report(rows, report_order(sort, direction), header, path, form)


def export_transaction_report(transactions: DataFrame, products: DataFrame, suppliers: DataFrame, users: DataFrame,
                              settings: DataFrame, path: str, form: str = "parquet", order: Sequence[Column] | None = None,
                              **filters) -> None:
    """Every movement the filters leave, the newest first (`order` must end in a unique column), and a header with the period."""
    rows = transactions_report(transactions, products, suppliers, users, **filters)
    header = (rows.agg(F.count(F.lit(1)).alias("row_count"))
              .withColumn("period_from", F.lit(filters.get("date_from")).cast("date"))
              .withColumn("period_to", F.lit(filters.get("date_to")).cast("date"))
              .withColumn("type", F.lit(filters.get("kind")).cast("string"))
              .withColumn("company", F.to_json(company_header(settings).scalar())))
    write_report(rows, order or [F.desc("created_at"), F.desc("id")], header, path, form)

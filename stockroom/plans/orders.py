"""Order lists, details, invoices, line resolution, statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.functions.money import outstanding
from stockroom.functions.parse import first_filled
from stockroom.operators.filters import apply_filters, date_between, search
from stockroom.operators.keyed import KeyedOrder, cut_points
from stockroom.operators.nesting import child_arrays, with_children
from stockroom.operators.paging import page_of
from stockroom.plans.catalog import with_user_name
from stockroom.plans.site import settings_map


def list_order():
    return [F.desc("created_at"), F.desc("id")]


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))


def with_item_count(orders: DataFrame, items: DataFrame) -> DataFrame:
    counted = orders.join(item_counts(items).withColumnRenamed("order_id", "id"), "id", "left")
    return counted.withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def filtered_orders(orders: DataFrame, status: str | None = None, payment_status: str | None = None,
                    customer_id: int | None = None, term: str | None = None, date_from: dt.date | None = None,
                    date_to: dt.date | None = None, ascii_only: bool = False) -> DataFrame:
    found = apply_filters(orders, status=status, payment_status=payment_status, customer_id=customer_id)
    found = search(found, term, ["order_number", "customer_name", "customer_phone"], ascii_only)
    return date_between(found, "created_at", date_from, date_to)


def order_list(orders: DataFrame, items: DataFrame, users: DataFrame, **filters) -> DataFrame:
    """Filtered orders with item count and creator; the caller pages by `list_order()`.

    Page the filtered orders first where only one page is wanted: the item side is then reduced to it.
    """
    return with_user_name(with_item_count(filtered_orders(orders, **filters), items), users,
                          "created_by", "created_by_name")


def order_page(orders: DataFrame, items: DataFrame, users: DataFrame, page: int = 1, limit: int = V.PAGE_LIMIT,
               **filters) -> DataFrame:
    """One page. The page is cut before the items are joined, so only its orders' items are counted."""
    shown = page_of(filtered_orders(orders, **filters), list_order(), page, limit)
    ids = shown.select(F.col("id").alias("order_id"))
    return with_user_name(with_item_count(shown, items.join(F.broadcast(ids), "order_id", "left_semi")), users,
                          "created_by", "created_by_name")


def order_summary(orders: DataFrame, items: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name_ref"))
    return order_list(orders, items, users).join(names, "customer_id", "left")


def order_documents(orders: DataFrame, items: DataFrame, products: DataFrame, users: DataFrame, **keyed) -> DataFrame:
    """Order detail with its items; each item carries its product's thumbnail and slug."""
    # Looked for before the join, which adds no rows.
    cuts = cut_points(items, ["order_id"], line_order(items), **keyed)
    looks = products.select(F.col("id").alias("product_id"), "thumbnail", "slug")
    lines = items.join(looks, "product_id", "left")
    arrays = child_arrays(lines, "order_id", line_order(items), [
        "id", "product_id", "product_name", "product_sku", "qty", "unit", "unit_price", "subtotal", "thumbnail", "slug"],
        "items", cuts=cuts)
    named = with_user_name(with_user_name(orders, users, "created_by", "created_by_name"),
                           users, "confirmed_by", "confirmed_by_name")
    return with_children(named, "id", arrays, "order_id", "items")


def line_order(items: DataFrame) -> list[str]:
    """Item ids are unique in the operational table; data with repeated ids brings further columns."""
    return [c for c in ("id", "product_name", "supplier_key", "qty", "subtotal") if c in items.columns]


def invoice_headers(orders: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    """Contact data of the customer record win over those typed into the order, unless they are empty."""
    known = customers.select(F.col("id").alias("customer_id"), F.col("address").alias("_addr"),
                             F.col("phone").alias("_phone"), F.col("email").alias("_email"))
    joined = with_user_name(orders, users, "created_by", "created_by_name").join(known, "customer_id", "left")
    return (joined
            .withColumn("customer_addr", first_filled(F.col("_addr"), F.col("customer_addr")))
            .withColumn("customer_phone", first_filled(F.col("_phone"), F.col("customer_phone")))
            .withColumn("customer_email", first_filled(F.col("_email"), F.col("customer_email")))
            .withColumn("outstanding", outstanding(F.col("total"), F.col("amount_paid")))
            .drop("_addr", "_phone", "_email"))


def invoice_lines(orders: DataFrame, items: DataFrame, **keyed) -> DataFrame:
    """Numbered item lines of every order."""
    cuts = cut_points(items, ["order_id"], line_order(items), **keyed)
    lines = items.join(orders.select(F.col("id").alias("order_id"), "order_number"), "order_id")
    return KeyedOrder(lines, ["order_id"], line_order(items), cuts=cuts).row_number("line_no").result()


def invoice_documents(orders: DataFrame, items: DataFrame, customers: DataFrame, users: DataFrame,
                      settings: DataFrame, **keyed) -> DataFrame:
    """Header, items and company data in one nested row (further parts for very long orders)."""
    arrays = child_arrays(items, "order_id", line_order(items), [
        "product_name", "product_sku", "qty", "unit", "unit_price", "subtotal"], "items", **keyed)
    documents = with_children(invoice_headers(orders, customers, users), "id", arrays, "order_id", "items")
    return documents.withColumn("company", settings_map(settings, V.INVOICE_SETTINGS).scalar())


def resolve_lines(typed: DataFrame, products: DataFrame) -> DataFrame:
    """Typed labels '[sku] name' (or the bare name) to products: id, sku, price, and quantity capped to stock.

    Lines that match nothing stay free text. Where labels repeat, the lowest product id wins.
    A stock of zero does not cap when the total is computed, but does when the label is picked; the label
    is picked here.
    """
    label = F.when(F.coalesce(F.col("sku"), F.lit("")) != "",
                   F.concat(F.lit("["), F.col("sku"), F.lit("] "), F.col("name"))).otherwise(F.col("name"))
    known = (products.withColumn("label", label)
             .groupBy("label").agg(F.min_by(F.struct(F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
                                                     "sell_price", "warehouse_stock"), "id").alias("p")))
    joined = typed.join(known, "label", "left")
    stock = F.coalesce(F.col("p.warehouse_stock"), F.lit(0))
    capped = F.when(F.col("p").isNull(), F.col("qty")).otherwise(F.least(F.col("qty"), stock))
    return joined.select(
        *[c for c in typed.columns if c not in ("qty", "unit_price")], "p.product_id", "p.product_sku",
        capped.alias("qty"), F.coalesce("p.sell_price", "unit_price").alias("unit_price"),
        (capped < F.col("qty")).alias("was_capped"))


def order_stats(orders: DataFrame, as_of: dt.date) -> DataFrame:
    status, created = F.col("status"), F.col("created_at")
    today, month = P.on_day(created, as_of), P.in_month(created, as_of)
    return orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status.isin("confirmed", "processing")).alias("processing"),
        F.count_if(status == "delivered").alias("delivered"),
        F.count_if(today).alias("today_count"),
        F.count_if(month).alias("this_month_count"),
        F.count_if(month & (status == "confirmed")).alias("month_confirmed_count"),
        F.count_if(month & status.isin("cancelled", "refunded")).alias("cancelled_count"))


def orders_daily(orders: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Orders per day for the `days` days ending with `as_of`, days without orders included."""
    counts = (date_between(orders, "created_at", as_of - dt.timedelta(days=days - 1), as_of)
              .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("order_count")))
    return day_spine(orders, as_of, days).join(counts, "day", "left").select(
        "day", F.date_format("day", "dd/MM").alias("label"), F.coalesce("order_count", F.lit(0)).alias("order_count"))


def day_spine(df: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """One row per day, ending with `as_of`."""
    last = F.lit(as_of)
    return df.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def customer_orders(orders: DataFrame, customer_id: int, limit: int = V.CUSTOMER_HISTORY) -> DataFrame:
    return apply_filters(orders, customer_id=customer_id).orderBy(*list_order()).limit(limit)

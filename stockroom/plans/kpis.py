"""Dashboard figures. One aggregate per table, however many figures it feeds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.plans.catalog import top_viewed
from stockroom.plans.orders import list_order, order_stats, orders_daily
from stockroom.plans.stock import stock_value


def one_row(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Put one-row frames side by side: union them with nulls and take the only value of each column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _unread() -> Column:
    return F.count_if(~F.col("is_read")).alias("unread_contacts")


def _value(name: str) -> Column:
    return F.coalesce(F.sum(stock_value()), F.lit(0)).cast("decimal(25,2)").alias(name)


def admin_kpis(t, as_of: dt.date) -> DataFrame:
    """`t` has one attribute per table (products, orders, ...)."""
    active = F.col("is_active")
    parts = [
        t.products.agg(F.count_if(active).alias("total_products"),
                       F.count_if(active & F.col("is_featured")).alias("featured_products")),
        t.categories.agg(F.count_if(active).alias("total_categories")),
        t.services.agg(F.count_if(active).alias("total_services")),
        t.testimonials.agg(_count("total_testimonials")),
        t.contacts.agg(_unread(), _count("total_contacts")),
        t.customers.agg(_count("total_customers")),
        t.orders.agg(_count("total_orders"), F.count_if(P.on_day(F.col("created_at"), as_of)).alias("today_orders")),
        t.suppliers.agg(_count("total_suppliers")),
    ]
    return one_row(parts, ["total_products", "total_categories", "total_services", "total_testimonials",
                           "unread_contacts", "total_contacts", "featured_products", "total_customers",
                           "total_orders", "today_orders", "total_suppliers"])


def warehouse_kpis(t, as_of: dt.date) -> DataFrame:
    stock, active = F.col("warehouse_stock"), F.col("is_active")

    def moved(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("qty").cast("bigint"))), F.lit(0))

    today = t.stock_transactions.where(P.on_day(F.col("created_at"), as_of))
    parts = [
        t.products.agg(_count("total_products"), F.count_if(P.low_stock(stock)).alias("low_stock"),
                       F.count_if(P.out_of_stock(stock)).alias("out_of_stock"), _value("inventory_value")),
        t.suppliers.agg(F.count_if(active).alias("total_suppliers")),
        t.customers.agg(F.count_if(active).alias("total_customers")),
        t.orders.agg(F.count_if(P.open_order()).alias("pending_orders")),
        today.agg(moved("in").alias("stock_in_today"), moved("out").alias("stock_out_today")),
    ]
    return one_row(parts, ["total_products", "low_stock", "out_of_stock", "total_suppliers", "total_customers",
                           "pending_orders", "stock_in_today", "stock_out_today", "inventory_value"])


def executive_kpis(t, as_of: dt.date, now: dt.datetime) -> DataFrame:
    """`as_of` is the day of the order figures, `now` the moment at which sessions must still be valid."""
    stock, created, status = F.col("warehouse_stock"), F.col("created_at"), F.col("status")
    live = F.col("is_active") & (F.col("expires_at") > P.time_literal(now))
    parts = [
        t.users.agg(F.count_if("is_active").alias("total_users")),
        t.sessions.agg(F.count_if(live).alias("active_sessions")),
        t.orders.agg(_count("total_orders"), F.count_if(status == "pending").alias("pending_orders"),
                     F.count_if(P.on_day(created, as_of)).alias("today_orders"),
                     F.count_if((status == "confirmed") & P.in_month(created, as_of)).alias("month_confirmed")),
        t.customers.agg(_count("total_customers")),
        t.suppliers.agg(_count("total_suppliers")),
        t.products.agg(_count("total_products"), F.count_if(P.new_for_kpi()).alias("new_products"),
                       F.count_if(P.low_or_out(stock)).alias("low_stock"),
                       F.count_if(P.out_of_stock(stock)).alias("out_of_stock"), _value("inventory_value")),
        t.contacts.agg(_unread()),
    ]
    return one_row(parts, ["total_users", "active_sessions", "total_orders", "pending_orders", "total_customers",
                           "total_suppliers", "total_products", "new_products", "today_orders", "month_confirmed",
                           "low_stock", "out_of_stock", "unread_contacts", "inventory_value"])


def role_kpis(t, as_of: dt.date, role: str) -> DataFrame:
    return admin_kpis(t, as_of).select(*V.ROLE_FIGURES.get(role, V.ROLE_FIGURES["other"]))


def marketing_dashboard(t, as_of: dt.date) -> dict[str, DataFrame]:
    """Its tiles, its order figures, the five newest orders and the most viewed products."""
    return {
        "figures": role_kpis(t, as_of, "marketing"),
        "orders": order_stats(t.orders, as_of),
        "newest_orders": t.orders.orderBy(*list_order()).limit(5),
        "top_products": top_viewed(t.products, label_chars=15),
    }


def executive_dashboard(t, as_of: dt.date, now: dt.datetime) -> dict[str, DataFrame]:
    from stockroom.plans.audit import recent_logs, users_by_role
    return {
        "figures": executive_kpis(t, as_of, now),
        "recent_logs": recent_logs(t.activity_logs),
        "users_by_role": users_by_role(t.users),
        "orders_daily": orders_daily(t.orders, as_of),
    }

"""Hand-computed figures of a small shop, and of an empty one."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from seeds import DAY, empty, shop

from stockroom.plans import audit, catalog, customers, kpis, orders, pricing, reconcile, stock


@pytest.fixture(scope="module")
def s(spark):
    return shop(spark)


def test_warehouse_and_executive_figures(s):
    w = kpis.warehouse_kpis(s, DAY.date()).first().asDict()
    assert w == {"total_products": 31, "low_stock": 17, "out_of_stock": 1, "total_suppliers": 5, "total_customers": 5, "pending_orders": 4,
                 "stock_in_today": 66, "stock_out_today": 18, "inventory_value": Decimal("286040000.00")}
    e = kpis.executive_kpis(s, DAY.date(), DAY).first()
    assert (e["low_stock"], e["new_products"], e["pending_orders"], e["today_orders"], e["month_confirmed"]) == (18, 3, 1, 5, 1)
    a = kpis.admin_kpis(s, DAY.date()).first()
    assert (a["total_products"], a["featured_products"], a["total_services"], a["total_testimonials"]) == (28, 8, 4, 5)


def test_order_statistics(s):
    r = orders.order_stats(s.orders, DAY.date()).first()
    assert (r["total"], r["pending"], r["processing"], r["delivered"]) == (5, 1, 3, 1)
    counts = orders.order_summary(s.orders, s.order_items, s.customers, s.users).orderBy("id").collect()
    assert [c["item_count"] for c in counts] == [1, 1, 1, 1, 2]
    spend = customers.customer_rollup(s.customers, s.orders).orderBy("id").collect()
    assert [int(c["total_spend_actual"]) for c in spend] == [8_500_000, 14_500_000, 45_000_000, 25_000_000, 32_000_000]


def test_stock_totals_include_products_without_movement(s):
    rows = {r["id"]: (r["total_in"], r["total_out"]) for r in stock.stock_summary(s.products, s.categories, s.stock_transactions).collect()}
    moved = {1: (10, 5), 2: (15, 0), 3: (15, 7), 4: (10, 6), 6: (5, 0), 21: (3, 0), 22: (8, 0)}
    assert rows == {i: moved.get(i, (0, 0)) for i in range(1, 32)}


def test_category_counts(s):
    every = catalog.category_counts(s.categories, s.products, False).orderBy("id").collect()
    active = catalog.category_counts(s.categories, s.products, True).orderBy("id").collect()
    assert [r["product_count"] for r in every] == [8, 6, 3, 5, 5, 4]
    assert [r["product_count"] for r in active] == [7, 6, 3, 4, 5, 3]


def test_reconciliation(s):
    assert {r["id"]: int(r["item_sum"]) for r in reconcile.order_differences(s.orders, s.order_items).collect()} == {3: 54_000_000, 5: 35_000_000}
    assert {r["id"]: r["ledger_qty"] for r in reconcile.stock_differences(s.products, s.stock_transactions).collect()} == {2: 15, 6: 5, 21: 3, 22: 8}
    assert [r["id"] for r in reconcile.price_differences(s.stock_transactions).collect()] == [2]
    assert reconcile.broken_links(s.stock_transactions).count() == 0


def test_next_number_and_roles(spark, s):
    new = spark.createDataFrame([(9, DAY)], "id long, created_at timestamp_ntz")
    assert pricing.assign_order_numbers(new, s.orders).first()["order_number"] == "ORD-2026-0006"
    full = spark.createDataFrame([("ORD-2026-9999",), ("ORD-2025-0004",)], "order_number string")
    assert pricing.assign_order_numbers(new, full).first()["order_number"] == "ORD-2026-10000"
    assert {r["role"]: r["user_count"] for r in audit.users_by_role(s.users).collect()} == dict.fromkeys(
        ["superadmin", "admin_gudang", "admin_website", "marketing"], 1)


def test_invoice_documents(s, spark):
    settings = spark.createDataFrame([("site_name", "The Shop"), ("secret", "x")], "key string, value string")
    docs = orders.invoice_documents(s.orders, s.order_items, s.customers, s.users, settings).orderBy("id").collect()
    assert [len(d["items"]) for d in docs] == [1, 1, 1, 1, 2]
    assert docs[4]["items"][1]["row_no"] == 2 and docs[0]["company"] == {"site_name": "The Shop"}


def test_empty_tables_give_zero_not_null(spark):
    e = empty(spark)
    for frame in (kpis.admin_kpis(e, DAY.date()), kpis.warehouse_kpis(e, DAY.date()), kpis.executive_kpis(e, DAY.date(), DAY),
                  orders.order_stats(e.orders, DAY.date()), stock.inventory_value(e.products)):
        assert all(v == 0 for v in frame.first())
    assert [r["order_count"] for r in orders.orders_daily(e.orders, DAY.date(), 3).collect()] == [0, 0, 0]
    assert stock.stock_summary(e.products, e.categories, e.stock_transactions).count() == 0


def test_exports_keep_every_row(spark, s, tmp_path):
    settings = spark.createDataFrame([("site_name", "The Shop")], "key string, value string")
    stock.export_stock_report(s.products, s.categories, settings, str(tmp_path / "stock"), sort="publish_status", direction="DESC")
    rows = spark.read.parquet(str(tmp_path / "stock/rows"))
    assert rows.count() == 31 and rows.agg(F.sum("stock_value")).first()[0] == Decimal("286040000.00")
    assert spark.read.parquet(str(tmp_path / "stock/header")).first()["company"] == '{"site_name":"The Shop"}'
    stock.export_transaction_report(s.stock_transactions, s.products, s.suppliers, s.users, settings, str(tmp_path / "tx"), kind="out")
    assert spark.read.parquet(str(tmp_path / "tx/header")).first()["row_count"] == 3

"""A small shop, for hand-computed figures."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

from stockroom.sources.tables import literal_table

DAY = dt.datetime(2026, 3, 10, 9)
# id, category, stock, cost in thousands, featured
STOCK = [
    (1, 1, 5, 5500, 1), (2, 1, 10, 750, 0), (3, 1, 8, 1700, 1), (4, 1, 4, 2000, 0), (5, 1, 3, 2800, 0), (6, 2, 3, 4200, 1),
    (7, 2, 2, 4500, 0), (8, 2, 6, 1100, 0), (9, 2, 2, 3500, 0), (10, 2, 4, 3000, 0), (11, 3, 1, 15000, 1), (12, 3, 2, 7500, 0),
    (13, 3, 1, 11000, 0), (14, 4, 5, 2700, 1), (15, 4, 1, 7500, 0), (16, 4, 4, 1700, 0), (17, 4, 6, 1300, 0), (18, 5, 1, 11500, 1),
    (19, 5, 2, 9000, 0), (20, 5, 3, 4200, 0), (21, 5, 20, 500, 0), (22, 6, 2, 5500, 0), (23, 6, 5, 1900, 1), (24, 6, 1, 6000, 0),
    (25, 1, 3, 2000, 1), (26, 1, 2, 3300, 0), (27, 2, 8, 380, 0), (28, 5, 15, 200, 0), (29, 6, 0, 0, 0), (30, 1, 3, 0, 0), (31, 4, 2, 0, 0)]
QUEUED = {29: "new", 30: "new", 31: "draft"}
# id, customer, status, payment, total
ORDERS = [(1, 1, "delivered", "paid", 8_500_000), (2, 2, "processing", "partial", 14_500_000), (3, 3, "confirmed", "unpaid", 45_000_000),
          (4, 4, "pending", "unpaid", 25_000_000), (5, 5, "processing", "paid", 32_000_000)]
# order, product, qty, price
ITEMS = [(1, 1, 1, 8_500_000), (2, 19, 1, 14_500_000), (3, 18, 3, 18_000_000), (4, 11, 1, 25_000_000), (5, 14, 4, 4_500_000), (5, 1, 2, 8_500_000)]
# product, type, qty, before, after, price, total
MOVES = [(1, "in", 10, 0, 10, 5_500_000, 55_000_000), (1, "out", 5, 10, 5, 8_500_000, 8_500_000), (3, "in", 15, 0, 15, 1_700_000, 25_500_000),
         (3, "out", 7, 15, 8, 2_800_000, 19_600_000), (6, "in", 5, 0, 5, 4_200_000, 21_000_000), (21, "in", 3, 0, 3, 5_500_000, 16_500_000),
         (22, "in", 8, 0, 8, 1_900_000, 15_200_000), (4, "in", 10, 0, 10, 2_000_000, 20_000_000), (4, "out", 6, 10, 4, 3_200_000, 19_200_000),
         (2, "in", 15, 0, 15, 750_000, 11_250_000)]


def shop(spark) -> SimpleNamespace:
    from decimal import Decimal

    def table(name, rows):
        return literal_table(spark, name, rows)

    return SimpleNamespace(
        products=table("products", [dict(
            id=i, category_id=c, name=f"Thing {i}", slug=f"thing-{i}", sku=f"T-{i}", warehouse_stock=s, cost_price=Decimal(k * 1000),
            sell_price=Decimal(k * 2000), publish_status=QUEUED.get(i, "published"), is_active=i not in QUEUED, is_featured=bool(f),
            unit="unit", created_by=2, created_at=DAY) for i, c, s, k, f in STOCK]),
        categories=table("categories", [dict(id=i, name=f"Room {i}", slug=f"room-{i}", sort_order=i, is_active=True) for i in range(1, 7)]),
        orders=table("orders", [dict(
            id=i, order_number=f"ORD-2026-{i:04d}", customer_id=c, customer_name=f"Customer {c}", status=s, payment_status=p,
            subtotal=Decimal(v), total=Decimal(v), discount=Decimal(0), shipping_cost=Decimal(0), amount_paid=Decimal(0), created_by=1,
            created_at=DAY) for i, c, s, p, v in ORDERS]),
        order_items=table("order_items", [dict(
            id=n, order_id=o, product_id=p, product_name=f"Thing {p}", product_sku=f"T-{p}", qty=q, unit_price=Decimal(v),
            subtotal=Decimal(q * v)) for n, (o, p, q, v) in enumerate(ITEMS, 1)]),
        stock_transactions=table("stock_transactions", [dict(
            id=n, product_id=p, type=k, qty=q, qty_before=b, qty_after=a, unit_price=Decimal(v), total_price=Decimal(x), created_at=DAY)
            for n, (p, k, q, b, a, v, x) in enumerate(MOVES, 1)]),
        customers=table("customers", [dict(id=i, code=f"C{i}", name=f"Customer {i}", is_active=True) for i in range(1, 6)]),
        suppliers=table("suppliers", [dict(id=i, code=f"S{i}", name=f"Supplier {i}", is_active=True) for i in range(1, 6)]),
        users=table("admin_users", [dict(id=i, username=f"u{i}", full_name=f"User {i}", role=r, is_active=True) for i, r in enumerate(
            ["superadmin", "admin_gudang", "admin_website", "marketing"], 1)]),
        services=table("services", [dict(id=i, name=f"Service {i}", is_active=True) for i in range(1, 5)]),
        testimonials=table("testimonials", [dict(id=i, name=f"Guest {i}", rating=5, is_active=True) for i in range(1, 6)]),
        contacts=table("contacts", []), sessions=table("login_sessions", []), notifications=table("notifications", []))


def empty(spark) -> SimpleNamespace:
    from stockroom.schemas import SCHEMAS
    names = {"users": "admin_users", "sessions": "login_sessions"}
    tables = ["products", "categories", "orders", "order_items", "stock_transactions", "customers", "suppliers", "users", "services",
              "testimonials", "contacts", "sessions", "notifications"]
    return SimpleNamespace(**{n: spark.createDataFrame([], SCHEMAS[names.get(n, n)]) for n in tables})

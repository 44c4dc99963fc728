"""Column functions and small jobs on edge cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import labels as L
from stockroom.functions import money as M
from stockroom.functions import parse, text
from stockroom.operators import checks, feeds, filters, paging
from stockroom.plans import audit, notify, pricing, slugs

T0 = dt.datetime(2026, 8, 5, 14, 30)


def values(spark, build, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


@pytest.mark.parametrize("build,inputs,want", [
    (parse.int_prefix, ["12abc", "-3", "abc", "", None, " 7.9"], [12, -3, None, None, None, 7]),
    (parse.money_prefix, ["12.345x", ".5", "1e3", "x", None, "-2"], [Decimal("12.35"), Decimal("0.50"), Decimal("1000.00"), None, None, Decimal("-2.00")]),
    (parse.is_truthy_number, ["0", "0.00", "", None, "2", "x", "-0"], [False, False, False, False, True, True, False]),
    (parse.flag, ["1", "true", "0", None, "yes"], [True, True, False, False, False]),
    (text.slugify, ["Meja Kopi  L-Shape!", "Kursi--Játi", None], ["meja-kopi-l-shape", "kursi-jti", None]),
    (text.split_tags, ["a, b,,a", ""], [["a", "b"], []]),
    (text.shorten, ["x" * 18, "x" * 19], ["x" * 18, "x" * 18 + "..."]),
    (lambda c: L.order_number(F.lit(2026), c.cast("long")), ["7", "12345"], ["ORD-2026-0007", "ORD-2026-12345"]),
    (L.number_of, ["ORD-2026-0012", "ORD-2026-x"], [12, None]),
])
def test_text_functions(spark, build, inputs, want):
    assert values(spark, build, inputs) == want


def test_money_and_labels(spark):
    amounts = [Decimal("1234567.50"), Decimal("0"), None, Decimal("999"), Decimal("1000")]
    assert values(spark, M.rupiah, amounts, "decimal(15,2)") == ["Rp 1.234.567,5", "Rp 0", "Rp 0", "Rp 999", "Rp 1.000"]
    assert values(spark, L.stock_badge, [0, 1, 3, 4], "int") == ["SOLD OUT", "STOK TERBATAS", "STOK TERBATAS", None]
    assert values(spark, L.date_time_label, [T0], "timestamp_ntz") == ["05 Agu 2026, 14.30"]
    assert values(spark, L.status_label, ["in", "ready", "odd", None]) == ["Masuk", "Ready", "odd", None]
    assert values(spark, text.stars, [3, 0, None], "int") == ["★★★☆☆", "★★★★★", "★★★★★"]
    assert values(spark, lambda c: text.label_pairs(c), ["Time: 3: weeks| plain ||"])[0] == [("Time", " 3: weeks"), (None, "plain")]


def test_search_is_literal_and_ignores_case_and_accents(spark):
    df = spark.createDataFrame([("Jati",), ("JATI",), ("játi",), ("50% off",), ("500 off",), (None,)], "name string")
    assert filters.search(df, "jati", ["name"]).count() == 3
    assert [r[0] for r in filters.search(df, "0%", ["name"]).collect()] == ["50% off"]
    assert filters.search(df, "", ["name"]).count() == 6


def test_pages_cover_everything_once(spark):
    df = spark.range(53).withColumn("g", F.col("id") % 3)
    order = [F.desc("g"), F.asc("id")]
    numbered = [r["id"] for p in range(1, 7) for r in paging.page_of(df, order, p, 10).collect()]
    keyset, last = [], None
    while page := paging.page_after(df, [("g", False), ("id", True)], last, 10).collect():
        keyset += [r["id"] for r in page]
        last = [page[-1]["g"], page[-1]["id"]]
    assert numbered == keyset == [r["id"] for r in df.orderBy(*order).collect()]
    assert paging.clamp(-3, 0) == (1, 20) and paging.clamp(2, 900, V.MAX_LOG_PAGE) == (2, 200)
    assert tuple(paging.page_info(df, 6, 10).first()) == (53, 6, 10, 6, 51, 53)


def test_pricing_rules(spark):
    heads = [(1, "A", "500", "0"), (2, " ", None, None), (3, "C", None, None), (4, "D", None, None), (5, "E", "-9", "x"), (6, "F", None, None), (7, "G", None, None)]
    items = [(1, 1, "p", "2abc", "100"), (2, 1, "p", "1", "1"), (4, 1, "p", "1", "0"), (5, 1, "p", "1", "10"), (6, 1, "p", "-1", "10"),
             (6, 2, "", "1", "1"), (7, 1, "p", "1", "-10")]
    h = spark.createDataFrame(heads, "order_ref long, customer_name string, discount string, shipping_cost string")
    i = spark.createDataFrame(items, "order_ref long, line_no long, product_name string, qty string, unit_price string")
    ok, lines, rejects = pricing.price_orders(h, i)
    assert {r["order_ref"]: (r["subtotal"], r["total"]) for r in ok.collect()} == {1: (200, 0), 5: (10, 10)}
    assert {r["order_ref"]: r["reason"] for r in rejects.collect()} == {
        2: "customer_missing", 3: "no_items", 4: "item_incomplete", 6: "qty_invalid", 7: "price_invalid"}
    assert lines.count() == 2


def test_slugs_yield_to_existing_and_earlier_rows(spark):
    new = spark.createDataFrame([(1, "Red Chair Big"), (2, "Red Chair"), (3, "Blue"), (4, "Lamp"), (5, "Lamp"), (6, "Desk")], "id long, name string")
    old = spark.createDataFrame([("blue-sofa",), ("blu",), ("desk",), ("lam",)], "slug string")
    for ranges in (None, 1, 4):
        assert {r["id"]: r["slug"] for r in slugs.assign_slugs(new, old, ranges=ranges).collect()} == {
            1: "red-chair-big", 2: "red-chair-2", 3: "blue-3", 4: "lamp", 5: "lamp-5", 6: "desk-6"}


def test_notifications_without_role_are_listed_not_counted(spark):
    notes = spark.createDataFrame([(1, None, None, False), (2, "marketing", 4, False), (3, None, 4, False), (4, "superadmin", None, False), (5, "marketing", None, True)],
                                  "id long, target_role string, target_user long, is_read boolean").withColumn("title", F.lit("t")).withColumn(
        "created_at", F.lit(T0).cast("timestamp_ntz"))
    users = spark.createDataFrame([(4, "marketing"), (5, "admin_gudang")], "id long, role string")
    boxes = {}
    for r in notify.inboxes(notes, users).collect():
        boxes.setdefault(r["user_id"], set()).add(r["id"])
    assert boxes == {4: {1, 2, 3, 5}, 5: {1, 3}}
    assert {r["user_id"]: r["unread"] for r in notify.unread_counts(notes, users).collect()} == {4: 2, 5: 0}


def test_cascade_follows_children(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    products = spark.createDataFrame([(1, 1, 2), (2, 2, 2)], "id long, created_by long, published_by long")
    notes = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "id long, target_user long, created_by long")
    out = feeds.delete_cascade({"admin_users": users, "products": products, "notifications": notes}, "admin_users", users.where("id = 1"))
    assert [tuple(r) for r in out["products"].orderBy("id").collect()] == [(1, None, 2), (2, 2, 2)]
    assert [tuple(r) for r in out["notifications"].collect()] == [(2, 2, None)]


def test_patch_and_rules(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, phone string")
    patch = spark.createDataFrame([(1, None, "1", 1), (1, "c", None, 2), (9, "z", None, 3)], "id long, name string, phone string, at int")
    new, rejects = feeds.apply_patch(base, patch, "id", ["at"], ["name", "phone"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, "c", "1"), (2, "b", "y")] and rejects.first()["id"] == 9
    changes = spark.createDataFrame([(1, "paid", None), (2, None, "paid"), (3, None, None)], "id long, status string, payment_status string")
    good, bad = checks.validate(changes, checks.order_change_rules(changes.columns))
    assert [r["id"] for r in good.collect()] == [2]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {1: ["status_invalid"], 3: ["nothing_to_change"]}


def test_permission_matrix(spark):
    matrix = audit.permission_matrix(spark)
    assert matrix.where("path = '/users' and role <> 'superadmin'").count() == 0
    assert matrix.where("action = 'DELETE_ORDER'").count() == 2


def test_prices_are_rounded_after_multiplying(spark):
    from stockroom.plans import pricing
    headers = spark.createDataFrame([(1, "Ann", "0", "0")], "order_ref long, customer_name string, discount string, shipping_cost string")
    items = spark.createDataFrame([(1, 1, "Ring", "3", "12.345")], "order_ref long, line_no int, product_name string, qty string, unit_price string")
    orders, lines, _ = pricing.price_orders(headers, items)
    assert str(orders.first().subtotal) == "37.04" and str(lines.first().unit_price) == "12.35"


def test_an_edit_can_empty_an_order(spark):
    from stockroom.plans import pricing
    ten, none_yet = Decimal(10), Decimal(0)
    orders = spark.createDataFrame([(1, "pending", 7, "Ann", "08", ten, none_yet, none_yet, ten), (2, "pending", 7, "Bob", "09", ten, none_yet, none_yet, ten)],
                                   "id long, status string, customer_id long, customer_name string, customer_phone string, "
                                   "subtotal decimal(15,2), discount decimal(15,2), shipping_cost decimal(15,2), total decimal(15,2)")
    items = spark.createDataFrame([(1, 5, "Ring", "R", 1, "set", ten, ten), (2, 5, "Ring", "R", 1, "set", ten, ten)],
                                  "order_id long, product_id long, product_name string, product_sku string, qty int, unit string, "
                                  "unit_price decimal(15,2), subtotal decimal(15,2)")
    edits = spark.createDataFrame([(1, 1, 1, None, "", "0", "3", True), (2, 2, 1, None, "", "0", "3", False)],
                                  "id long, order_id long, created_at int, customer_id long, customer_name string, discount string, "
                                  "shipping_cost string, items_given boolean")
    none = spark.createDataFrame([], "edit_id long, line_no int, product_id long, product_name string, product_sku string, qty string, unit_price string")
    new, left, _ = pricing.reprice(orders, items, edits, none)
    assert {r.id: (str(r.total), r.customer_phone) for r in new.collect()} == {1: ("3.00", None), 2: ("13.00", None)}
    assert [r.order_id for r in left.collect()] == [2]

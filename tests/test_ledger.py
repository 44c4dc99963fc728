"""The parallel ledger against a row-by-row loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stockroom.functions import predicates as P
from stockroom.plans import ledger, settlement, workflow

T0 = dt.datetime(2026, 1, 1)


def book(opening, moves):
    """Row by row: (posted, refused ids)."""
    stock, posted, refused = dict(opening), {}, set()
    for at, i, product, kind, qty in sorted(moves):
        if product not in stock or (kind != "adjustment" and qty <= 0):
            refused.add(i)
            continue
        before = stock[product]
        if kind == "out" and before < qty:
            refused.add(i)
            continue
        stock[product] = {"in": before + qty, "out": before - qty, "adjustment": qty}[kind]
        posted[i] = (before, stock[product], abs(stock[product] - before) if kind == "adjustment" else qty)
    return posted, refused, stock


def frames(spark, opening, moves):
    return (spark.createDataFrame(list(opening.items()), "product_id long, opening_qty int"),
            spark.createDataFrame([(p, at, i, k, q) for at, i, p, k, q in moves],
                                  "product_id long, created_at timestamp_ntz, id long, type string, qty int"))


def random_moves(seed, n, products, hot=0.0, outs=3):
    rng = random.Random(seed)
    kinds = ["in"] * 2 + ["out"] * outs + ["adjustment"] * (seed % 2)
    return [(T0 + dt.timedelta(days=rng.randrange(40)), i, 1 if rng.random() < hot else rng.randrange(1, products + 2),
             rng.choice(kinds), rng.randrange(0, 9)) for i in range(n)]


@pytest.mark.parametrize("seed,hot,per_slice", [(1, 0.0, None), (2, 0.0, None), (3, 0.8, 60), (6, 0.9, 40)])
def test_posting_matches_the_loop(spark, seed, hot, per_slice):
    moves = random_moves(seed, 300, 6, hot)
    opening = {p: p % 4 for p in range(1, 7)}  # product 7 is unknown
    posted, refused, stock = book(opening, moves)
    keyed = {"rows_per_slice": per_slice} if per_slice else {}
    start, rows = frames(spark, opening, moves)
    got, rejects = ledger.post_ledger(start, rows, **keyed)
    assert {r["id"]: (r["qty_before"], r["qty_after"], r["qty"]) for r in got.collect()} == posted
    assert {r["id"] for r in rejects.collect()} == refused
    assert {r["product_id"]: r["closing_qty"] for r in ledger.closing_stock(start, got).collect()} == stock


def test_reject_reasons_and_ties(spark):
    moves = [(T0, 1, 1, "out", 3), (T0, 2, 1, "out", 3), (T0, 3, 1, "adjustment", 10), (T0, 4, 1, "out", 10),
             (T0, 5, 1, "in", 2), (T0, 6, 9, "in", 1), (T0, 7, 1, "in", 0), (T0, 8, 1, "return", 1)]
    start, rows = frames(spark, {1: 5}, moves)
    got, rejects = ledger.post_ledger(start, rows)
    assert {r["id"]: r["reason"] for r in rejects.collect()} == {
        2: "insufficient_stock", 6: "product_not_found", 7: "qty_invalid", 8: "type_invalid"}
    assert [(r["id"], r["qty_before"], r["qty_after"], r["qty"]) for r in got.orderBy("id").collect()] == [
        (1, 5, 2, 3), (3, 2, 10, 8), (4, 10, 0, 10), (5, 0, 2, 2)]


def test_publish_follows_stock(spark):
    moves = [(T0, 1, 1, "out", 5), (T0, 2, 2, "out", 5), (T0, 3, 2, "in", 1), (T0, 4, 3, "out", 5), (T0, 5, 4, "adjustment", 0)]
    start, rows = frames(spark, {1: 5, 2: 5, 3: 5, 4: 5}, moves)
    products = spark.createDataFrame([(1, "published"), (2, "published"), (3, "draft"), (4, "published")], "id long, publish_status string")
    got = ledger.publish_after_stock(products, ledger.post_ledger(start, rows)[0])
    assert {r["id"]: r["publish_status"] for r in got.collect()} == {1: "out_of_stock", 2: "published", 3: "draft", 4: "published"}


def test_short_products_alone_are_replayed_and_shuffled_once(spark):
    moves = [(T0 + dt.timedelta(days=n), n, n % 4, "out", 2) for n in range(40)]
    start, rows = frames(spark, {0: 100, 1: 100, 2: 3, 3: 5}, moves)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ledger.post_ledger(start, rows)[0]
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r["product_id"], r["id"]): r["qty_after"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The join with the openings brings a product's movements together; nothing shuffles them again.
    assert "REPARTITION_BY_COL" not in plan
    assert found == {**{(p, p + 4 * n): 98 - 2 * n for p in (0, 1) for n in range(10)}, (2, 2): 1, (3, 3): 3, (3, 7): 1}


# --- order changes --------------------------------------------------------------------------------
DEDUCTED = {"confirmed", "processing", "ready", "delivered"}


def run_changes(opening, orders, items, changes):
    """Change by change, all items or none."""
    stock = dict(opening)
    state = {o: ("pending", "unpaid") for o in orders}
    accepted, refused, booked = {}, set(), {}
    for at, i, order, status, payment in sorted(changes, key=lambda c: c[:2]):
        old, paid = state[order]
        new = status or old
        need = {}
        for p, q in items.get(order, []):
            if p in stock:
                need[p] = need.get(p, 0) + q
        if (old in DEDUCTED) != (new in DEDUCTED):
            sign = -1 if new in DEDUCTED else 1
            if sign < 0 and any(stock[p] < q for p, q in need.items()):
                refused.add(i)
                continue
            for p, q in need.items():
                booked[(i, p)] = (stock[p], stock[p] + sign * q)
                stock[p] += sign * q
        accepted[i] = (old, new, paid, payment or paid)
        state[order] = (new, payment or paid)
    return accepted, refused, booked


@pytest.mark.parametrize("seed,keyed", [(1, {}), (3, {"rows_per_slice": 25}), (4, {"stalled": 2.0, "walk_rows": 9}),
                                        (5, {"stalled": 2.0, "walk_rows": 1000, "rows_per_slice": 30})])
def test_order_changes_match_the_loop(spark, seed, keyed):
    rng = random.Random(seed)
    orders = range(1, 41)
    items = {o: [(1 if rng.random() < 0.5 else rng.randrange(1, 8), rng.randrange(1, 5)) for _ in range(rng.randrange(4))] for o in orders}
    items[1].append((None, 3))
    opening = {p: rng.randrange(4, 25) for p in range(1, 7)}  # product 7 is unknown
    statuses = [None, "pending", "confirmed", "processing", "ready", "delivered", "cancelled", "refunded"]
    changes = [(T0 + dt.timedelta(days=rng.randrange(25)), i, 1 if rng.random() < 0.3 else rng.choice(orders),
                rng.choice(statuses), rng.choice([None, "paid", "unpaid"])) for i in range(220)]
    accepted, refused, booked = run_changes(opening, orders, items, changes)
    assert refused and booked
    order_rows = spark.createDataFrame([(o, "pending", "unpaid") for o in orders], "id long, status string, payment_status string")
    item_rows = spark.createDataFrame([(o * 100 + n, o, p, q, q * 1.0, q * 1.0) for o, its in items.items() for n, (p, q) in enumerate(its)],
                                      "id long, order_id long, product_id long, qty int, unit_price double, subtotal double")
    change_rows = spark.createDataFrame([(i, o, s, p, at) for at, i, o, s, p in changes],
                                        "id long, order_id long, status string, payment_status string, created_at timestamp_ntz")
    start = spark.createDataFrame(list(opening.items()), "product_id long, opening_qty int")
    ok, moved, rejects = workflow.settle_order_changes(change_rows, order_rows, item_rows, start, **keyed)
    assert {r["id"]: (r["old_status"], r["new_status"], r["old_payment"], r["new_payment"]) for r in ok.collect()} == accepted
    assert {r["id"] for r in rejects.collect()} == refused
    assert {(r["change_id"], r["product_id"]): (r["qty_before"], r["qty_after"]) for r in moved.collect()} == booked
    keyed = {k: v for k, v in keyed.items() if k == "rows_per_slice"}
    lines = workflow.ledger_lines(moved, item_rows, **keyed).orderBy("change_id", "product_id", "qty_after").collect()
    by_pair = {}
    for r in lines:
        by_pair.setdefault((r["change_id"], r["product_id"]), []).append((r["qty_before"], r["qty_after"], r["qty"], r["type"]))
    assert set(by_pair) == set(booked)
    for pair, (before, after) in booked.items():
        ends = {b for b, *_ in by_pair[pair]} ^ {a for _, a, *_ in by_pair[pair]}
        assert ends == {before, after}


def test_rounds_hand_on_less_each_time(spark, monkeypatch):
    """Products run short one after the other; what is certain leaves, so later rounds are smaller."""
    sizes = {}

    def counted(df, name):
        kept = write(df, name)
        sizes.setdefault(name, []).append(kept.count())
        return kept

    write = settlement.written
    monkeypatch.setattr(settlement, "written", counted)
    # Order n takes from products n and n + 1, so the outcome of one decides the next; the orders of product 1000 are settled at once.
    chain = [(n, n) for n in range(1, 13)] + [(n, n + 1) for n in range(1, 13)] + [(n, 1000) for n in range(100, 200)]
    lines = spark.createDataFrame([(o, p, 1, 1 if p < 1000 else 5) for o, p in chain], "order_id long, product_id long, qty long, opening_qty long")
    started = spark.createDataFrame([(n, n, T0 + dt.timedelta(days=n), "confirmed", "pending") for n in {o for o, _ in chain}],
                                    "id long, order_id long, created_at timestamp_ntz, status string, _status0 string")
    refused = {r["txn_id"] for r in settlement.refused_changes(started, lines, stalled=0.0).collect()}
    assert refused == {n for n in range(2, 13, 2)} | set(range(105, 200))
    assert len(sizes["state"]) > 4 and sizes["state"][-1] < sizes["state"][0] / 10
    assert sizes["balances"][-1] < sizes["balances"][0] / 10


def test_status_walk_and_null_product(spark):
    """confirm, go on (no movement), cancel, confirm again."""
    orders = spark.createDataFrame([(1, "pending", "unpaid")], "id long, status string, payment_status string")
    steps = ["confirmed", "processing", "cancelled", "confirmed"]
    changes = spark.createDataFrame([(i, 1, s, None, T0 + dt.timedelta(days=i)) for i, s in enumerate(steps)],
                                    "id long, order_id long, status string, payment_status string, created_at timestamp_ntz")
    items = spark.createDataFrame([(1, 5, 2), (1, None, 9)], "order_id long, product_id long, qty int")
    moves = workflow.status_movements(changes.withColumn("changed_by", P.F.lit(1)), orders, items).orderBy("change_id").collect()
    assert [(m["change_id"], m["type"], m["reference_type"], m["product_id"]) for m in moves] == [
        (0, "out", "sale", 5), (2, "in", "return", 5), (3, "out", "sale", 5)]


def test_spend_counts_every_return_to_paid(spark):
    orders = spark.createDataFrame([(1, 7, 10.0, "pending", "unpaid"), (2, None, 5.0, "pending", "unpaid")],
                                   "id long, customer_id long, total double, status string, payment_status string")
    steps = [(1, "paid"), (1, "unpaid"), (1, "paid"), (1, "paid"), (2, "paid"), (1, "refunded")]
    changes = spark.createDataFrame([(i, o, None, p, T0 + dt.timedelta(days=i)) for i, (o, p) in enumerate(steps)],
                                    "id long, order_id long, status string, payment_status string, created_at timestamp_ntz")
    spend = workflow.paid_spend(workflow.transitions(changes, orders), orders).collect()
    assert [(r["customer_id"], float(r["added_spend"]), r["paid_count"]) for r in spend] == [(7, 20.0, 2)]

"""Order status changes: stock movements, payment, spend; publish workflow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import parse
from stockroom.functions import predicates as P
from stockroom.functions.money import at_least_zero
from stockroom.operators.keyed import SEARCH, KeyedOrder, cut_points
from stockroom.plans.ledger import all_accepted
from stockroom.plans.settlement import CHANGE_ORDER, STALLED, WALK_ROWS, refused_changes
from stockroom.session import written


def with_start_state(changes: DataFrame, orders: DataFrame) -> DataFrame:
    """Changes with the state their order is in before the feed; changes of unknown orders drop out."""
    start = orders.select(F.col("id").alias("order_id"), F.col("status").alias("_status0"),
                          F.col("payment_status").alias("_payment0"))
    return changes.join(start, "order_id")


def transitions(changes: DataFrame, orders: DataFrame, refused: DataFrame | None = None, **keyed) -> DataFrame:
    """Old and new status and payment of every change.

    A change that leaves a value out keeps it. Changes listed in `refused` (`txn_id` = change id) had no
    effect on what follows; their own old values are still those they met.
    """
    cuts = keyed.pop("cuts", None) or cut_points(changes.where(F.col("order_id").isNotNull()), ["order_id"], CHANGE_ORDER, **keyed)
    return _transitions(with_start_state(changes, orders), refused, cuts, **keyed)


def _transitions(rows: DataFrame, refused: DataFrame | None, cuts: DataFrame | str | None = SEARCH, **keyed) -> DataFrame:
    took = F.lit(True)
    if refused is not None:
        rows = rows.join(refused.select(F.col("txn_id").alias("id"), F.lit(True).alias("_refused")), "id", "left")
        took = F.col("_refused").isNull()
    ordered = (KeyedOrder(rows, ["order_id"], CHANGE_ORDER, cuts=cuts, **keyed)
               .last_value(F.when(took, F.col("status")), "_old_status", include_current=False)
               .last_value(F.when(took, F.col("payment_status")), "_old_payment", include_current=False))
    return (ordered.result()
            .withColumn("old_status", F.coalesce("_old_status", "_status0"))
            .withColumn("old_payment", F.coalesce("_old_payment", "_payment0"))
            .withColumn("new_status", F.coalesce("status", "old_status"))
            .withColumn("new_payment", F.coalesce("payment_status", "old_payment"))
            .drop("_old_status", "_old_payment", "_status0", "_payment0", "_refused"))


def movement_type() -> Column:
    """'out' when a change takes the order into the deducted states, 'in' when it takes it out of them."""
    before, after = P.deducted(F.col("old_status")), P.deducted(F.col("new_status"))
    return F.when(~before & after, "out").when(before & ~after, "in")


def status_movements(changes: DataFrame, orders: DataFrame, items: DataFrame, refused: DataFrame | None = None,
                     **keyed) -> DataFrame:
    """One movement per item of every order that crosses the border; items without a product move nothing."""
    crossing = transitions(changes, orders, refused, **keyed).withColumn("type", movement_type())
    crossing = crossing.where(F.col("type").isNotNull()).select(
        F.col("id").alias("change_id"), "order_id", "type", "created_at", "changed_by", "new_status",
        F.when(F.col("type") == "out", "sale").otherwise("return").alias("reference_type"))
    return crossing.join(items.where(F.col("product_id").isNotNull()), "order_id")


def settle_order_changes(changes: DataFrame, orders: DataFrame, items: DataFrame, opening: DataFrame,
                         walk_rows: int = WALK_ROWS, stalled: float = STALLED, **keyed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply status changes with their stock effect, all items of a change or none.

    A change whose goods are short is undone whole: status, payment and stock stay, and the order's next
    change starts from the old state. Returns the accepted transitions, the stock movements per change and
    product with balances, and the refused changes with a `reason`.

    `plans.settlement` finds the refusals; balances are running sums over what was accepted.
    """
    known = opening.select("product_id", F.col("opening_qty").cast("bigint"))
    lines = (items.where(F.col("product_id").isNotNull()).groupBy("order_id", "product_id")
             .agg(F.sum(F.col("qty").cast("bigint")).alias("qty")).join(known, "product_id"))
    lines = written(lines, "per-product")
    started = written(with_start_state(changes, orders), "started")
    refused = written(refused_changes(started, lines, walk_rows, stalled, **keyed), "refused")

    cuts = cut_points(started, ["order_id"], CHANGE_ORDER, **keyed)
    final = written(_transitions(started, refused, cuts), "transitions")
    accepted = final.join(refused.withColumnRenamed("txn_id", "id"), "id", "left_anti")
    moves = accepted.withColumn("type", movement_type()).where(F.col("type").isNotNull()).select("id", "order_id", "type", "created_at")
    ledger = all_accepted(moves.join(lines, "order_id"), CHANGE_ORDER, **keyed).drop("opening_qty").withColumnRenamed("id", "change_id")
    rejects = changes.join(refused.withColumnRenamed("txn_id", "id"), "id", "left_semi").withColumn(
        "reason", F.lit("insufficient_stock"))
    return accepted, ledger, rejects


def ledger_lines(ledger: DataFrame, items: DataFrame, line_order: Sequence[str] = ("id",), **keyed) -> DataFrame:
    """The ledger per item line: an order with several lines of one product books them one after the other."""
    lines = items.where(F.col("product_id").isNotNull()).select(
        "order_id", "product_id", "unit_price", "subtotal", F.col("qty").cast("bigint").alias("line_qty"),
        *[F.col(c).alias(f"_o_{c}") for c in line_order])
    joined = ledger.drop("qty").join(lines, ["order_id", "product_id"])
    signed = F.when(F.col("type") == "in", F.col("line_qty")).otherwise(-F.col("line_qty"))
    ordered = KeyedOrder(joined, ["change_id", "product_id"], [f"_o_{c}" for c in line_order], **keyed)
    posted = ordered.running_sum(signed, "_moved").result()
    return (posted.withColumn("qty_after", F.col("qty_before") + F.col("_moved"))
            .withColumn("qty_before", F.col("qty_after") - signed).withColumnRenamed("line_qty", "qty")
            .drop("_moved", *[f"_o_{c}" for c in line_order]))


def apply_changes(orders: DataFrame, accepted: DataFrame) -> DataFrame:
    """Orders after the accepted transitions; the last confirmation names who confirmed.

    A change may also carry `amount_paid` (not below zero; text that is no number counts as zero) and `notes`.
    """
    at = F.struct(*CHANGE_ORDER)
    confirmed = F.when(F.col("status") == "confirmed", at)
    given = {}
    if "amount_paid" in accepted.columns and "amount_paid" in orders.columns:
        given["amount_paid"] = (F.col("amount_paid").isNotNull(), at_least_zero(parse.money_or_zero(F.col("amount_paid"))))
    if "notes" in accepted.columns and "notes" in orders.columns:
        given["notes"] = (F.coalesce(F.col("notes") != "", F.lit(False)), F.col("notes"))
    final = accepted.groupBy(F.col("order_id").alias("id")).agg(
        F.max_by("new_status", at).alias("_status"), F.max_by("new_payment", at).alias("_payment"),
        F.max_by(F.when(F.col("status") == "confirmed", F.col("changed_by")), confirmed).alias("_by"),
        *[F.max_by(value, F.when(is_given, at)).alias(f"_{name}") for name, (is_given, value) in given.items()])
    return (orders.join(final, "id", "left")
            .withColumn("status", F.coalesce("_status", "status"))
            .withColumn("payment_status", F.coalesce("_payment", "payment_status"))
            .withColumn("confirmed_by", F.coalesce("_by", "confirmed_by"))
            .withColumns({name: F.coalesce(f"_{name}", name) for name in given}).select(*orders.columns))


def into_paid(accepted: DataFrame) -> DataFrame:
    return accepted.where((F.col("new_payment") == "paid") & (F.col("old_payment") != "paid"))


def paid_spend(accepted: DataFrame, orders: DataFrame) -> DataFrame:
    """Lifetime spend per customer: the order's total on every transition into paid.

    An order that leaves paid and comes back counts twice; refunds take nothing away.
    """
    times = into_paid(accepted).groupBy("order_id").agg(F.count(F.lit(1)).alias("_times"))
    paid = orders.where(F.col("customer_id").isNotNull()).join(times, orders["id"] == times["order_id"])
    return paid.groupBy("customer_id").agg(
        F.sum(F.col("total") * F.col("_times")).cast("decimal(25,2)").alias("added_spend"),
        F.sum("_times").alias("paid_count"))


def apply_publish(products: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publish, unpublish and status requests (id, product_id, status, changed_by, created_at) in order.

    `publish` is a request for 'published', `unpublish` one for 'hidden'. Active means published.
    """
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    valid = F.coalesce(F.col("status").isin(V.PUBLISH_STATUSES), F.lit(False))
    judged = changes.join(known, "product_id", "left").withColumn(
        "reason", F.when(~valid, "status_invalid").when(F.col("_known").isNull(), "product_not_found")).drop("_known")
    at = F.struct("created_at", "id")
    out = F.when(F.col("status") == "published", at)
    final = judged.where(F.col("reason").isNull()).groupBy(F.col("product_id").alias("id")).agg(
        F.max_by("status", at).alias("_status"), F.max_by("changed_by", out).alias("_by"), F.max(
            F.when(F.col("status") == "published", F.col("created_at"))).alias("_at"))
    joined = products.join(final, "id", "left")
    values = {
        "publish_status": F.coalesce("_status", "publish_status"),
        "is_active": F.coalesce(F.col("_status") == "published", F.col("is_active")),
        "published_by": F.coalesce("_by", "published_by"),
    }
    if "published_at" in products.columns:
        values["published_at"] = F.coalesce("_at", "published_at")
    applied = joined.select(*[values.get(c, F.col(c)).alias(c) for c in products.columns])
    return applied, judged.where(F.col("reason").isNotNull())

"""Order intake: validation, pricing, numbering, later edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import labels as L
from stockroom.functions import parse
from stockroom.functions.money import at_least_zero, money, order_total
from stockroom.operators.keyed import KeyedOrder


#: What an order edit sets besides customer and amounts.
EDITED_HEADERS = ["customer_phone", "customer_email", "customer_addr", "shipping_addr", "payment_method", "notes", "delivery_date"]


def _judged_items(items: DataFrame) -> DataFrame:
    """Items with `_qty`, `_price` and `_fault`: why the item is refused, null if it is good.

    A quantity or price of zero counts as not given. The texts are parsed in a projection of their own, so
    that the patterns run once per row however often the numbers are used.
    """
    parsed = (items.withColumn("_qty", parse.int_prefix(F.col("qty")))
              .withColumn("_price", parse.price_prefix(F.col("unit_price"))))
    # A number that parses to something else than zero was given; only the rest is looked at again.
    given = [(F.col(number) != 0) | parse.is_truthy_number(F.col(raw)) for number, raw in (("_qty", "qty"), ("_price", "unit_price"))]
    complete = (F.col("product_name") != "") & F.coalesce(given[0], F.lit(False)) & F.coalesce(given[1], F.lit(False))
    fault = (F.when(~F.coalesce(complete, F.lit(False)), "item_incomplete")
             .when(F.coalesce(F.col("_qty") <= 0, F.lit(True)), "qty_invalid")
             .when(F.coalesce(F.col("_price") < 0, F.lit(True)), "price_invalid"))
    return parsed.withColumn("_fault", fault)


def price_orders(headers: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Priced orders, their lines, and refused headers with a `reason`.

    `headers`: order_ref, customer_name, discount, shipping_cost and anything else; `items`: order_ref,
    line_no, product_name, qty, unit_price. Quantities and amounts may be text. The first bad item in line
    order names the reason.
    """
    items = _judged_items(items)
    fault = F.col("_fault")
    sums = items.groupBy("order_ref").agg(
        F.sum(F.when(fault.isNull(), F.col("_qty") * F.col("_price"))).alias("_sum"),
        F.min_by(fault, F.when(fault.isNotNull(), F.col("line_no"))).alias("_fault"))
    joined = headers.join(sums.withColumn("_has_items", F.lit(True)), "order_ref", "left")
    reason = (F.when(F.coalesce(F.trim("customer_name"), F.lit("")) == "", "customer_missing")
              .when(F.col("_has_items").isNull(), "no_items").otherwise(F.col("_fault")))
    checked = joined.withColumn("reason", reason)
    subtotal, discount, shipping = (F.col(c) for c in ("subtotal", "discount", "shipping_cost"))
    orders = (checked.where(F.col("reason").isNull())
              .withColumn("customer_name", F.trim("customer_name"))
              .withColumn("subtotal", money(F.col("_sum")))
              .withColumn("discount", at_least_zero(parse.money_or_zero(discount)))
              .withColumn("shipping_cost", at_least_zero(parse.money_or_zero(shipping)))
              .withColumn("total", order_total(subtotal, discount, shipping))
              .drop("_sum", "_fault", "_has_items", "reason"))
    lines = (items.join(orders.select("order_ref"), "order_ref", "left_semi")
             .withColumn("subtotal", money(F.col("_qty") * F.col("_price")))
             .withColumn("qty", F.col("_qty")).withColumn("unit_price", money(F.col("_price"))).drop("_qty", "_price", "_fault"))
    rejects = checked.where(F.col("reason").isNotNull()).select(*headers.columns, "reason")
    return orders, lines, rejects


def last_numbers(existing: DataFrame) -> DataFrame:
    """Highest order number per year."""
    number = F.col("order_number")
    own = existing.where(number.rlike(f"^{V.ORDER_NUMBER_PREFIX}-[0-9]{{4}}-"))
    suffix = parse.int_prefix(F.substring_index(number, "-", -1))
    return own.groupBy(F.element_at(F.split(number, "-"), 2).cast("int").alias("year")).agg(
        F.coalesce(F.max(suffix), F.lit(0)).alias("last_seq"))


def assign_order_numbers(new: DataFrame, existing: DataFrame | None = None, order=("created_at", "id"),
                         **keyed) -> DataFrame:
    """Number new orders within their year, going on from the year's highest number."""
    dated = new.withColumn("year", F.year("created_at"))
    numbered = KeyedOrder(dated, ["year"], list(order), **keyed).row_number("_seq").result()
    if existing is not None:
        numbered = numbered.join(last_numbers(existing), "year", "left")
        numbered = numbered.withColumn("_seq", F.col("_seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
    return numbered.withColumn("order_number", L.order_number(F.col("year"), F.col("_seq"))).drop("_seq")


def reprice(orders: DataFrame, items: DataFrame, edits: DataFrame,
            edit_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply order edits: orders, items, and refused edits.

    `edits`: id, order_id, created_at, customer_id, customer_name, discount, shipping_cost, the columns of
    `EDITED_HEADERS`, and optionally `items_given`, which tells an edit that empties the order from one without
    items; `edit_items`: edit_id, line_no, product_id, product_name, product_sku, qty, unit, unit_price, notes.
    Closed orders refuse edits. An edit sets all edited headers, to null where it leaves them out, and one with
    items replaces all items. The header counts negative quantities as 0, the item rows take at least 1, so the
    two may disagree (the reconciliation report shows where). Stock is not touched.
    """
    edits = edits.withColumns({c: F.lit(None).cast("string") for c in EDITED_HEADERS if c not in edits.columns})
    edit_items = edit_items.withColumns({c: F.lit(None).cast("string") for c in ("unit", "notes") if c not in edit_items.columns})
    open_now = ~F.col("status").isin(V.CLOSED_STATUSES)
    states = orders.select(F.col("id").alias("order_id"), open_now.alias("_open"))
    judged = edits.join(states, "order_id", "left")
    rejects = judged.where(~F.coalesce("_open", F.lit(False))).withColumn(
        "reason", F.when(F.col("_open").isNull(), "order_not_found").otherwise("order_closed")).drop("_open")
    valid = judged.where("_open")

    qty, price = parse.int_or_zero(F.col("qty")), F.greatest(parse.price_or_zero(F.col("unit_price")), F.lit(0).cast("decimal(20,6)"))
    sums = edit_items.groupBy("edit_id").agg(
        F.sum(F.greatest(qty, F.lit(0)) * price).alias("_edit_sum"))
    valid = valid.join(sums, valid["id"] == sums["edit_id"], "left")
    at = F.struct("created_at", "id")

    def last(column: str, given: Column) -> Column:
        return F.max_by(F.when(given, F.col(column)), F.when(given, at))

    has_items = F.coalesce("items_given", F.col("edit_id").isNotNull()) if "items_given" in edits.columns else F.col("edit_id").isNotNull()
    valid = valid.withColumn("_edit_sum", F.coalesce("_edit_sum", F.lit(0)))
    final = valid.groupBy("order_id").agg(
        F.max_by("discount", at).alias("_discount"), F.max_by("shipping_cost", at).alias("_shipping"),
        last("customer_id", F.col("customer_id").isNotNull()).alias("_customer_id"),
        last("customer_name", F.coalesce(F.col("customer_name") != "", F.lit(False))).alias("_customer_name"),
        last("_edit_sum", has_items).alias("_edit_sum"), last("id", has_items).alias("_items_from"),
        F.max_by(F.struct(*[parse.blank_to_null(F.col(c).cast("string")).alias(c) for c in EDITED_HEADERS]), at).alias("_header"))
    joined = orders.join(final.withColumn("_edited", F.lit(True)), orders["id"] == final["order_id"], "left").drop("order_id")
    edited = F.coalesce("_edited", F.lit(False))
    amounts = {
        "customer_id": F.coalesce("_customer_id", "customer_id"),
        "customer_name": F.coalesce("_customer_name", "customer_name"),
        "subtotal": money(F.coalesce("_edit_sum", "subtotal")),
        "discount": F.when(edited, at_least_zero(parse.money_or_zero(F.col("_discount")))).otherwise(F.col("discount")),
        "shipping_cost": F.when(edited, at_least_zero(parse.money_or_zero(F.col("_shipping")))).otherwise(F.col("shipping_cost")),
    }
    for c in EDITED_HEADERS:
        if c in orders.columns:
            kind = orders.schema[c].dataType
            amounts[c] = F.when(edited, F.col("_header")[c].cast(kind)).otherwise(F.col(c))
    new_orders = joined.select(*[amounts.get(c, F.col(c)).alias(c) for c in orders.columns], edited.alias("_edited"))
    total = F.when(F.col("_edited"), order_total(F.col("subtotal"), F.col("discount"), F.col("shipping_cost")))
    new_orders = new_orders.withColumn("total", F.coalesce(total, "total")).select(*orders.columns)

    replaced = final.where(F.col("_items_from").isNotNull()).select("order_id", F.col("_items_from").alias("edit_id"))
    taken = F.greatest(F.coalesce(F.nullif(parse.int_or_zero(F.col("qty")), F.lit(0)), F.lit(1)), F.lit(1)).cast("int")
    fresh = (edit_items.join(replaced, "edit_id").withColumn("_price", price).withColumn("qty", taken)
             .withColumn("unit_price", money(F.col("_price"))).withColumn("subtotal", money(F.col("qty") * F.col("_price")))
             .withColumn("unit", F.coalesce(parse.blank_to_null(F.col("unit")), F.lit("unit")))
             .withColumn("notes", parse.blank_to_null(F.col("notes")))
             .select("order_id", "product_id", "product_name", "product_sku", "qty", "unit", "unit_price", "subtotal", "notes"))
    if "notes" not in items.columns:
        fresh = fresh.drop("notes")
    kept = items.join(replaced.select("order_id"), "order_id", "left_anti")
    return new_orders, kept.unionByName(fresh, allowMissingColumns=True), rejects

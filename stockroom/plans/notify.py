"""Notifications: who is told what, inboxes, unread counts, read marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions.money import rupiah
from stockroom.operators.keyed import first_per_key


def fill(template: str, **parts: Column) -> Column:
    """A text with {names} as a column: 'Order {number}' -> concat."""
    pieces, rest = [], template
    while "{" in rest:
        plain, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(plain), F.coalesce(parts[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def fan_out(events: DataFrame, roles: Sequence[str], kind: str, title: str, message: Column, link: str,
            source: str) -> DataFrame:
    """One notification per event and role."""
    return events.select(
        F.explode(F.array(*[F.lit(r) for r in roles])).alias("target_role"), F.lit(kind).alias("type"),
        F.lit(title).alias("title"), message.alias("message"), F.lit(link).alias("link"),
        F.lit(source).alias("source"), F.col("id").cast("bigint").alias("source_id"), "created_at")


def order_created(orders: DataFrame) -> DataFrame:
    text = fill(V.NOTE_ORDER_TEXT, number=F.col("order_number"), customer=F.col("customer_name"), total=rupiah(F.col("total")))
    return fan_out(orders, V.NOTE_ORDER_ROLES, "success", V.NOTE_ORDER_TITLE, text, V.LINK_ORDERS, "order")


def paid_notes(paid: DataFrame) -> DataFrame:
    """`paid`: transitions into paid with their `order_number`."""
    text = fill(V.NOTE_PAID_TEXT, number=F.col("order_number"))
    return fan_out(paid, V.NOTE_ORDER_ROLES, "success", V.NOTE_PAID_TITLE, text, V.LINK_ORDERS, "payment")


def order_paid(paid: DataFrame, orders: DataFrame) -> DataFrame:
    """`paid`: the transitions into paid."""
    return paid_notes(paid.join(orders.select(F.col("id").alias("order_id"), "order_number"), "order_id"))


def low_sales(ledger: DataFrame) -> DataFrame:
    """Sales of orders that leave three or fewer. Issues booked by hand are sales without an order; they alert nobody."""
    sale = (F.col("type") == "out") & (F.col("reference_type") == "sale") & F.col("order_id").isNotNull()
    return ledger.where(sale & (F.col("qty_after") <= V.LOW_STOCK))


def stock_alert(ledger: DataFrame, products: DataFrame) -> DataFrame:
    """Every sale of an order that leaves three or fewer. The ledger row holds the balance, so no state is needed."""
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    text = fill(V.NOTE_STOCK_TEXT, product=F.col("product_name"), left=F.col("qty_after"))
    return fan_out(low_sales(ledger).join(names, "product_id"), V.NOTE_STOCK_ROLES, "warning", V.NOTE_STOCK_TITLE, text, V.LINK_STOCK, "stock")


def contact_received(contacts: DataFrame) -> DataFrame:
    subject = F.coalesce(F.nullif("subject", F.lit("")), F.lit(V.NOTE_NO_SUBJECT))
    text = fill(V.NOTE_CONTACT_TEXT, name=F.col("name"), subject=subject)
    return fan_out(contacts, V.NOTE_CONTACT_ROLES, "info", V.NOTE_CONTACT_TITLE, text, V.LINK_CONTACTS, "contact")


def product_created(products: DataFrame) -> DataFrame:
    text = fill(V.NOTE_PRODUCT_TEXT, product=F.col("name"))
    return fan_out(products, V.NOTE_PRODUCT_ROLES, "info", V.NOTE_PRODUCT_TITLE, text, V.LINK_NEW_PRODUCTS, "product")


def notifications_for(notes: DataFrame, role: str, user_id: int) -> DataFrame:
    """What one user sees: own role, own id, or no role at all."""
    return notes.where((F.col("target_role") == role) | (F.col("target_user") == user_id) | F.col("target_role").isNull())


def inboxes(notes: DataFrame, users: DataFrame, count: int = 20) -> DataFrame:
    """The newest `count` notifications of every user, for all users at once.

    Each of the three ways to be addressed can add at most `count` rows, so each is cut to that first: per
    role, per user, and once for those without a role. No user meets more than three times `count` rows.
    """
    newest = [F.desc("created_at"), F.desc("id")]
    columns = ["user_id", "id", "created_at", "title", "is_read"]
    people = users.select(F.col("id").alias("user_id"), "role")
    by_role = first_per_key(notes.where(F.col("target_role").isNotNull()), ["target_role"], newest, count)
    by_user = first_per_key(notes.where(F.col("target_user").isNotNull()), ["target_user"], newest, count)
    open_to_all = notes.where(F.col("target_role").isNull()).orderBy(*newest).limit(count)
    shared = open_to_all.agg(F.collect_list(F.struct("id", "created_at", "title", "is_read")).alias("n")).scalar()
    rows = (by_role.join(people, F.col("target_role") == F.col("role")).select(*columns)
            .union(by_user.join(people, F.col("target_user") == F.col("user_id")).select(*columns))
            .union(people.withColumn("_n", shared).select("user_id", F.inline("_n"))
                   .select(*columns)))
    return first_per_key(rows.dropDuplicates(["user_id", "id"]), ["user_id"], newest, count)


def unread_counts(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Unread notifications per user: by role plus by user, minus those that address both ways.

    Notifications without a role are listed in inboxes but not counted here.
    """
    unread = notes.where(~F.col("is_read"))
    count = F.count(F.lit(1))
    by_role = unread.where(F.col("target_role").isNotNull()).groupBy(F.col("target_role").alias("role")).agg(count.alias("_r"))
    by_user = unread.where(F.col("target_user").isNotNull()).groupBy(F.col("target_user").alias("user_id")).agg(count.alias("_u"))
    both = (unread.where(F.col("target_role").isNotNull() & F.col("target_user").isNotNull())
            .groupBy(F.col("target_role").alias("role"), F.col("target_user").alias("user_id")).agg(count.alias("_b")))
    people = users.select(F.col("id").alias("user_id"), "role")
    joined = people.join(by_role, "role", "left").join(by_user, "user_id", "left").join(both, ["role", "user_id"], "left")
    number = F.coalesce("_r", F.lit(0)) + F.coalesce("_u", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return joined.select("user_id", "role", number.alias("unread"))


def apply_reads(notes: DataFrame, reads: DataFrame) -> DataFrame:
    """Read marks: rows with `notification_id` mark one; rows with `role` and `user_id` mark everything
    addressed to that role or user up to `created_at`.

    Notifications are addressed to the fixed roles, so the role marks are at most as many rows and are broadcast.
    """
    single = reads.where(F.col("notification_id").isNotNull()).select(
        F.col("notification_id").alias("id"), F.lit(True).alias("_one")).distinct()
    every = reads.where(F.col("notification_id").isNull())
    roles = F.broadcast(every.where(F.col("role").isin(V.ROLES)).groupBy(F.col("role").alias("target_role")).agg(
        F.max("created_at").alias("_role_read")))
    people = every.groupBy(F.col("user_id").alias("target_user")).agg(F.max("created_at").alias("_user_read"))
    joined = notes.join(single, "id", "left").join(roles, "target_role", "left").join(people, "target_user", "left")
    seen = (F.coalesce("_one", F.lit(False))
            | F.coalesce(F.col("created_at") <= F.col("_role_read"), F.lit(False))
            | F.coalesce(F.col("created_at") <= F.col("_user_read"), F.lit(False)))
    return joined.withColumn("is_read", F.col("is_read") | seen).select(*notes.columns)

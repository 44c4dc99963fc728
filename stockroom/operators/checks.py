"""Row rules, duplicate keys and delete guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.schemas import ALLOWED, REQUIRED


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the array `reasons` of failed rule names.

    A rule is a condition that must hold; null counts as failed.
    """
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules.items()]))
    checked = df.withColumn("reasons", failed)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def not_blank(column: str) -> Column:
    return F.trim(F.col(column)) != ""


def new_user_rules() -> dict[str, Column]:
    return {
        "login_missing": not_blank("username") & (F.length("username") <= V.MAX_USERNAME),
        "role_invalid": F.col("role").isin(V.ROLES),
        "password_length": F.length("password").between(V.MIN_PASSWORD, V.MAX_PASSWORD),
        "email_invalid": F.col("email").rlike(V.EMAIL_PATTERN),
    }


def order_change_rules(columns: Sequence[str] = ("amount_paid", "notes")) -> dict[str, Column]:
    """A change may leave a status out, but must not name an unknown one, and must change something.

    `columns` are what the feed has besides the two states.
    """
    status, payment = F.col("status"), F.col("payment_status")
    changed = status.isNotNull() | payment.isNotNull()
    if "amount_paid" in columns:
        changed |= F.col("amount_paid").isNotNull()
    if "notes" in columns:
        changed |= F.coalesce(F.col("notes") != "", F.lit(False))
    return {
        "status_invalid": status.isNull() | status.isin(V.ORDER_STATUSES),
        "payment_invalid": payment.isNull() | payment.isin(V.PAYMENT_STATUSES),
        "nothing_to_change": changed,
    }


def table_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """What the table's declaration asks of each row: values that must be there, and value lists. Only the given columns are looked at."""
    rules = {f"{c}_missing": F.col(c).isNotNull() for c in REQUIRED.get(table, []) if c in columns}
    for c, values in ALLOWED.get(table, {}).items():
        if c in columns:
            rules[f"{c}_invalid"] = F.col(c).isNull() | F.col(c).isin(values)
    return rules


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; nulls never clash."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def deletable_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paid orders may not be deleted."""
    paid = F.coalesce(F.col("payment_status") == "paid", F.lit(False))
    return orders.where(~paid), orders.where(paid).withColumn("reason", F.lit("order_paid"))


def deletable_customers(customers: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers with orders may not be deleted; the second frame tells how many orders hold them."""
    counts = (orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
              .agg(F.count(F.lit(1)).alias("order_count")).withColumnRenamed("customer_id", "id"))
    free = customers.join(counts, "id", "left_anti")
    blocked = customers.join(counts, "id").withColumn("reason", F.lit("customer_has_orders"))
    return free, blocked

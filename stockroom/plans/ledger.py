"""The stock ledger: balances before and after every movement, movements that run short refused.

A refused movement changes every later balance of its product, so the ledger is defined row by row. It is
computed in parallel as follows.

1. Balances with everything accepted are running sums (a correction restarts the sum). If no product runs
   short, they are the answer, with built-in windows only.
2. Products that do run short are replayed in order: rows are brought together by product (and slice, for a hot
   product), sorted, and streamed through a small loop that holds one balance at a time. Only the others go through the sums again.
3. A slice of a hot product needs the balance it starts with; `plans.transfer` finds it in three passes, however many
   slices there are.

Order changes that are all or nothing over several products are `plans.settlement`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.operators.keyed import SLICE, KeyedOrder, cut_points
from stockroom.plans.transfer import IN, OUT, SET, slice_entries
from stockroom.session import cut

ORDER = ("created_at", "id")


def _delta() -> Column:
    qty = F.col("qty").cast("bigint")
    return F.when(F.col("type") == "in", qty).when(F.col("type") == "out", -qty).otherwise(F.lit(0).cast("bigint"))


def valid_movements(opening: DataFrame, movements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Movements with their product's `opening_qty`, and those refused before any balance is looked at.

    `opening`: product_id, opening_qty. In and out need a positive quantity; a correction gives the new level.
    """
    joined = movements.join(opening.select("product_id", F.col("opening_qty").cast("bigint")), "product_id", "left")
    moving = F.col("type").isin("in", "out")
    reason = (F.when(~F.coalesce(moving | (F.col("type") == "adjustment"), F.lit(False)), "type_invalid")
              .when(F.coalesce(moving & (F.col("qty") <= 0), F.lit(False)) | F.col("qty").isNull(), "qty_invalid")
              .when(F.col("opening_qty").isNull(), "product_not_found"))
    judged = joined.withColumn("reason", reason)
    return (judged.where(F.col("reason").isNull()).drop("reason"),
            judged.where(F.col("reason").isNotNull()).drop("opening_qty"))


def all_accepted(rows: DataFrame, order: Sequence[str] = ORDER, **keyed) -> DataFrame:
    """Balances if nothing is refused: opening or last correction, plus the sum since."""
    delta, level = F.col("_delta"), F.col("qty").cast("bigint")
    ordered = (KeyedOrder(rows.withColumn("_delta", _delta()), ["product_id"], order, **keyed)
               .running_sum(delta, "_sum")
               .last_value(F.when(F.col("type") == "adjustment", level - F.col("_sum")), "_base", include_current=False))
    before = F.coalesce("_base", "opening_qty") + F.col("_sum") - delta
    return (ordered.result().withColumn("qty_before", before)
            .withColumn("qty_after", F.when(F.col("type") == "adjustment", level).otherwise(before + delta))
            .drop("_delta", "_sum", "_base"))


def _stream_balances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by product, slice and order; keeps one running balance."""
    balance = 0
    for batch in batches:
        column = {name: batch.column(name).to_pylist() for name in ("_place", "_kind", "qty", "_entry")}
        before, after, enough = [], [], []
        for place, kind, qty, entry in zip(*column.values(), strict=True):
            if place == 1:
                balance = entry
            before.append(balance)
            ok = kind != OUT or balance >= qty
            if kind == SET:
                balance = qty
            elif ok:
                balance += qty if kind == IN else -qty
            after.append(balance)
            enough.append(ok)
        arrays = [pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(enough, pa.bool_())]
        names = ["qty_before", "qty_after", "_enough"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def _kind() -> Column:
    return F.when(F.col("type") == "in", IN).when(F.col("type") == "out", OUT).otherwise(SET)


def _replay(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    # The window numbers the rows and leaves each product's rows together in their order, with no shuffle of its own
    # where a join by product has them together already.
    keys = [c for c in ("product_id", SLICE) if c in rows.columns]
    ready = rows.withColumn("_kind", _kind()).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    schema = T.StructType([*ready.schema.fields, T.StructField("qty_before", T.LongType()),
                           T.StructField("qty_after", T.LongType()), T.StructField("_enough", T.BooleanType())])
    return ready.mapInArrow(_stream_balances, schema).drop("_kind", "_place")


def _replay_single(rows: DataFrame, order: Sequence[str], cuts: DataFrame | None) -> DataFrame:
    """Replay of movements that stand alone. Without hot products one pass is enough."""
    if cuts is None:
        alone = rows.withColumn("_entry", F.col("opening_qty"))
        return _replay(alone, order).withColumnRenamed("_enough", "accepted").drop("_entry")
    sliced = KeyedOrder(rows, ["product_id"], order, cuts=cuts).df
    hot = sliced.where("_hot").withColumn("_kind", _kind())
    entries = slice_entries(hot, list(order))
    # One row per slice; the slices of products that are not hot start with the opening.
    started = sliced.join(entries, ["product_id", SLICE], "left").withColumn("_entry", F.coalesce("_entry", "opening_qty"))
    return _replay(started, order).withColumnRenamed("_enough", "accepted").drop(SLICE, "_entry", "_hot")


def post_ledger(opening: DataFrame, movements: DataFrame, order: Sequence[str] = ORDER, keep: bool = False,
                **keyed) -> tuple[DataFrame, DataFrame]:
    """Post movements that stand alone: the ledger with balances, and refused movements with a `reason`.

    `keep` writes the replayed rows to the shared folder; worth it when both results are used.

    Corrections are booked with the size of the difference as quantity, without sign, so a signed change is
    `qty_after - qty_before`.
    """
    rows, rejects = valid_movements(opening, movements)
    # Looked for before the join with the openings, which adds no rows.
    cuts = cut_points(movements.where(F.col("product_id").isNotNull()), ["product_id"], order, **keyed)
    balances = all_accepted(rows, order, cuts=cuts)
    short = (F.col("type") == "out") & (F.col("qty_before") < F.col("qty"))
    touched = cut(balances.where(short).select("product_id").distinct())
    if touched.isEmpty():
        posted = balances
    else:
        # The openings are parted, one row per product, and bring their movements with them: each movement is shuffled once more,
        # to the replay or to the running sums, and if both join by shuffle they read the same one.
        replayed = _replay_single(valid_movements(opening.join(touched, "product_id", "left_semi"), movements)[0], order, cuts)
        replayed = cut(replayed) if keep else replayed
        refused = replayed.where(~F.col("accepted"))
        rejects = rejects.unionByName(refused.select(*movements.columns, F.lit("insufficient_stock").alias("reason")))
        kept = all_accepted(valid_movements(opening.join(touched, "product_id", "left_anti"), movements)[0], order, cuts=cuts)
        posted = kept.unionByName(replayed.where("accepted").drop("accepted"))
    booked = F.when(F.col("type") == "adjustment", F.abs(F.col("qty_after") - F.col("qty_before"))).otherwise(F.col("qty"))
    return posted.withColumn("qty", booked.cast("bigint")).drop("opening_qty"), rejects


def closing_stock(opening: DataFrame, ledger: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Stock per product after the ledger; products without movement keep their opening."""
    last = ledger.groupBy("product_id").agg(F.max_by("qty_after", F.struct(*order)).alias("_last"))
    return opening.join(last, "product_id", "left").select(
        "product_id", F.coalesce("_last", F.col("opening_qty").cast("bigint")).alias("closing_qty"))


def publish_after_stock(products: DataFrame, ledger: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Publish status follows the stock: sold out when an issue reaches 0, back when goods come in from 0.

    Only these two states take part and corrections do not, so the last such movement decides.
    """
    event = (F.when((F.col("type") == "out") & (F.col("qty_after") == 0), "out_of_stock")
             .when((F.col("type") == "in") & (F.col("qty_before") == 0), "published"))
    at = F.when(event.isNotNull(), F.struct(*order))
    last = ledger.groupBy(F.col("product_id").alias("id")).agg(F.max_by(event, at).alias("_status"))
    moved = F.col("publish_status").isin("published", "out_of_stock")
    return (products.join(last, "id", "left")
            .withColumn("publish_status", F.when(moved, F.coalesce("_status", "publish_status"))
                        .otherwise(F.col("publish_status"))).select(*products.columns))

"""The balance that each slice of a hot product starts with, without walking through the slices one after the other.

What a slice does to the balance it is entered with is a function that is made from the slice's own rows: between two break points the same
issues are refused, so the balance is moved by the same amount. Three passes over the rows follow each other, however many slices there
are: one bounds the balance each slice can be entered with, one makes each slice's function on these balances, and one reads the
functions of a product in turn (one row per slice).

The bounds keep the functions small: while a product has plenty its balance is known exactly, and once it may have been short
the bounds are no further apart than the largest quantity asked for since and what came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.keyed import SLICE
from stockroom.session import written

IN, OUT, SET = 0, 1, 2
#: Stands for "no bound" in the constants below; sums of quantities stay far from it.
NONE = -2 ** 62


class Bounds:
    """The lowest and highest balance after some movements, each as max(`least`, balance before + `change`)."""

    def __init__(self, floor: int = 0) -> None:
        """`floor`: no balance is ever below it, nor above 0."""
        self.floor, self.low, self.high = floor, (NONE, 0), (NONE, 0)

    def add(self, kind: int, qty: int) -> None:
        if kind == SET:
            self.low = self.high = (qty, NONE)
            return
        step = qty if kind == IN else -qty
        # An issue leaves 0 or more if it is taken, and less than it asked for if it is refused.
        floors = (NONE, NONE) if kind == IN else (self.floor, qty - 1)
        for name, floor in zip(("low", "high"), floors):
            least, change = getattr(self, name)
            setattr(self, name, (max(floor, least + step) if least > NONE // 2 else floor, change + step if change > NONE // 2 else NONE))

    @staticmethod
    def after(bound: tuple[int, int], balance: int) -> int:
        least, change = bound
        return max(least, balance + change) if change > NONE // 2 else least


class Transfer:
    """The exit balance of every entry balance from `low` to `high`.

    Entries are ranges that begin at `start`; each belongs to a class of ranges whose balances are the same from here on
    (from `value`, `size` of them). A movement looks at classes only; classes that have become equal are put together.
    """

    def __init__(self, low: int, high: int):
        self.start, self.owner = np.array([low], np.int64), np.array([0])
        self.value, self.size = np.array([low], np.int64), np.array([high - low + 1], np.int64)
        self.shift, self.unlike = 0, 1

    def add(self, kind: int, qty: int) -> None:
        if kind == IN:
            self.shift += qty
        elif kind == SET:
            self.value, self.size, self.shift = np.full_like(self.value, qty), np.zeros_like(self.size), 0
            self._join()
        else:
            least = qty - self.shift  # classes from here on have enough
            cut = np.flatnonzero((self.value < least) & (self.value + self.size > least))
            for c in cut:
                self._split(int(c), int(least - self.value[c]))
            self.value[self.value >= least] -= qty
            if len(self.value) > 2 * self.unlike:
                self._join()

    def _split(self, c: int, at: int) -> None:
        mine = np.flatnonzero(self.owner == c)
        self.start = np.concatenate([self.start, self.start[mine] + at])
        self.owner = np.concatenate([self.owner, np.full(len(mine), len(self.value))])
        self.value = np.append(self.value, self.value[c] + at)
        self.size = np.append(self.size, self.size[c] - at)
        self.size[c] = at

    def _join(self) -> None:
        both, self.owner_of = np.unique(np.stack([self.value, self.size]), axis=1, return_inverse=True)
        self.owner = self.owner_of.ravel()[self.owner]
        self.value, self.size = both[0].copy(), both[1].copy()
        self.unlike = max(16, len(self.value))

    @property
    def settled(self) -> bool:
        """Whether every entry leads to the same balance."""
        return len(self.value) == 1 and self.size[0] <= 1

    def pieces(self) -> tuple[list[int], list[int], list[bool]]:
        """Sorted entry ranges: where they begin, the balance there, and whether it grows with the entry."""
        self._join()
        order = np.argsort(self.start)
        owner = self.owner[order]
        return self.start[order].tolist(), (self.value[owner] + self.shift).tolist(), (self.size[owner] > 0).tolist()


def exit_of(entry: int, start: list[int], value: list[int], grows: list[bool]) -> int:
    at = int(np.searchsorted(start, entry, "right")) - 1
    return value[at] + (entry - start[at] if grows[at] else 0)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[int, int]]]]:
    """(product, slice, low, high) of each run of rows, and its (kind, qty) part by part."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        begin = 0
        keys = list(zip(*columns[:4], strict=True))
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin], zip(columns[4][begin:i], columns[5][begin:i], strict=True)
                begin = i


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, held, out = None, Bounds(), []

    def done() -> None:
        if unit is not None:
            out.append((*unit[:2], *held.low, *held.high))

    for key, rows in _units(batches):
        if key != unit:
            done()
            unit, held = key, Bounds(key[2])
        for kind, qty in rows:
            held.add(kind, qty)
    done()
    yield _batch(out, [pa.int64(), pa.int32(), *[pa.int64()] * 4], ["product_id", SLICE, "low_least", "low_change", "high_least", "high_change"])


def _function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, made, balance, out = None, None, None, []

    def done() -> None:
        if unit is not None:
            out.append((*unit[:2], *(made.pieces() if balance is None else ([unit[2]], [balance], [False]))))

    for key, rows in _units(batches):
        if key != unit:
            done()
            unit, made = key, Transfer(key[2], key[3])
            balance = key[2] if key[2] == key[3] else None
        for kind, qty in rows:
            if balance is not None:  # one balance only
                balance = qty if kind == SET else balance + qty if kind == IN else balance - qty if balance >= qty else balance
                continue
            made.add(kind, qty)
            if made.settled:
                balance = int(made.value[0]) + made.shift
    done()
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    yield _batch(out, kinds, ["product_id", SLICE, "start", "value", "grows"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _in_turn(step):
    """A walk over one row per slice, sorted by product and slice: `step(row, state)` gives the row's result and the state behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["product_id"] != product:
                    product, state = row["product_id"], (row["opening_qty"], row["opening_qty"])
                out.append((product, row[SLICE], *state))
                state = step(row, state)
            yield _batch(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["product_id", SLICE, "low", "high"])
    return run


def _next_bounds(row: dict, state: tuple[int, int]) -> tuple[int, int]:
    low, high = ((row[f"{name}_least"], row[f"{name}_change"]) for name in ("low", "high"))
    return min(Bounds.after(low, state[0]), Bounds.after(high, state[1])), Bounds.after(high, state[1])


def _next_balance(row: dict, state: tuple[int, int]) -> tuple[int, int]:
    balance = exit_of(state[0], row["start"], row["value"], row["grows"])
    return balance, balance


def slice_entries(rows: DataFrame, order: list[str]) -> DataFrame:
    """(product_id, slice, _entry): the balance before the first row of every slice.

    `rows`: product_id, the slice, `order`, `_kind`, qty, opening_qty. Only these columns are read.
    """
    slim = rows.select("product_id", SLICE, *order, "_kind", F.col("qty").cast("bigint").alias("qty"))
    opening = rows.groupBy("product_id").agg(F.min("opening_qty").alias("opening_qty"))

    def walked(frame: DataFrame, run, schema: str) -> DataFrame:
        ready = frame.repartition("product_id", SLICE).sortWithinPartitions("product_id", SLICE, *order)
        return written(ready.select("product_id", SLICE, "low", "high", "_kind", "qty").mapInArrow(run, schema), "slices")

    def in_turn(frame: DataFrame, step) -> DataFrame:
        ready = frame.join(opening, "product_id").repartition("product_id").sortWithinPartitions("product_id", SLICE)
        return written(ready.mapInArrow(_in_turn(step), f"product_id long, {SLICE} int, low long, high long"), "entries")

    # Balances below zero can only come from the opening or a correction.
    floors = rows.groupBy("product_id").agg(F.least(F.lit(0).cast("bigint"), F.min("opening_qty"), F.min(
        F.when(F.col("_kind") == SET, F.col("qty").cast("bigint")))).alias("low"))
    bounds = walked(slim.join(floors, "product_id").withColumn("high", F.lit(None).cast("bigint")), _bound,
                    f"product_id long, {SLICE} int, low_least long, low_change long, high_least long, high_change long")
    entered = in_turn(bounds, _next_bounds)
    functions = walked(slim.join(entered, ["product_id", SLICE]), _function,
                       f"product_id long, {SLICE} int, start array<long>, value array<long>, grows array<boolean>")
    return in_turn(functions, _next_balance).select("product_id", SLICE, F.col("low").alias("_entry"))

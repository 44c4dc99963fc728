"""Per-key ordered calculations that stay parallel when one key holds much of the data.

A plain window puts all rows of a key into one task. Here a key with more rows than `rows_per_slice` is
cut into consecutive slices of its own order; each slice is an ordinary window group, and what has to
cross a slice border (a sum so far, the last value so far) is carried by a small table with one row per
slice of a hot key. Keys below the limit keep the plain window, and if there are no hot keys the plan is
the plain window plan.

The result is exact for every choice of cut points; they only decide how even the slices are. There are
at most rows / `rows_per_slice` hot keys; their counts and cut points are broadcast only after their bytes have
been measured. Beyond `MAX_BROADCAST_BYTES` they are joined by shuffle on the key and a salt, so a hot key's rows
still go to many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import cut

ROWS_PER_SLICE = 4_000_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 64
SALT = "_salt"
_SAMPLES_PER_SLICE = 32
_STRIDE = 64
SLICE = "_slice"
SEARCH = "search"


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame | None:
    """keys + `_cuts` (sorted order values where slices begin) for the hot keys only; None without any."""
    hot = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
              .where(F.col("_rows") > rows_per_slice)
              .withColumn("_slices", F.ceil(F.col("_rows") / rows_per_slice).cast("int")))
    if hot.isEmpty():
        return None
    spread, hot = _spread(hot)
    # A content hash picks the sample, so a recomputed task picks the same rows. It places the cuts
    # only; a sample holds `_SAMPLES_PER_SLICE` order values per slice.
    share = 1 << 40
    wanted = F.col("_slices").cast("double") * _SAMPLES_PER_SLICE * share / F.col("_rows")
    at = F.struct(*order)
    sampled = (_salted(df.select(*keys, *order), order, spread).join(hot, [*keys, *([SALT] if spread else [])])
               .where(F.pmod(F.xxhash64(*order), F.lit(share)) < wanted)
               .groupBy(*keys, "_slices").agg(F.sort_array(F.collect_list(at)).alias("_sample")))
    step = F.greatest(F.lit(1), F.floor(F.size("_sample") / F.col("_slices")).cast("int"))
    points = F.filter("_sample", lambda _, i: (i > 0) & (i % F.col("_step") == 0))
    cuts = cut(sampled.withColumn("_step", step).select(*keys, F.array_distinct(points).alias("_cuts")))
    return _spread(cuts)[1]


def _spread(small: DataFrame) -> tuple[bool, DataFrame]:
    """A table to join with: broadcast if its bytes allow it, else once per salt (and True)."""
    held = small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if held <= MAX_BROADCAST_BYTES:
        return False, F.broadcast(small)
    return True, small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salted(df: DataFrame, order: Sequence[str], spread: bool) -> DataFrame:
    return df.withColumn(SALT, F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")) if spread else df


def slices_of(cuts: DataFrame) -> DataFrame:
    """One row per hot key with its cut points."""
    return cuts.where(F.col(SALT) == 0).drop(SALT) if SALT in cuts.columns else cuts


def _slice_of(cuts: Column, at: Column) -> Column:
    """How many cut points are at or below `at`; a coarse step first, then within one stride."""
    coarse = F.filter(cuts, lambda point, i: (i % _STRIDE == 0) & (point <= at))
    begin = (F.size(coarse) - 1) * _STRIDE
    fine = F.filter(F.slice(cuts, begin + 1, F.lit(_STRIDE)), lambda point: point <= at)
    found = F.when(F.size(coarse) == 0, F.lit(0)).otherwise(begin + F.size(fine))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


class KeyedOrder:
    """Rows of `df` in `order` within `keys`. Methods add columns and return the same object.

    `keys` and `order` columns must not be null, and `order` should be total within a key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 rows_per_slice: int = ROWS_PER_SLICE, cuts: DataFrame | str | None = SEARCH):
        """`cuts` are those of an earlier `cut_points` call (None if it found none)."""
        self.keys = list(keys)
        self.order = list(order)
        self.cuts = cut_points(df, self.keys, self.order, rows_per_slice) if isinstance(cuts, str) else cuts
        self.sliced = self.cuts is not None
        if self.sliced:
            spread = SALT in self.cuts.columns
            df = (_salted(df, self.order, spread).join(self.cuts, [*self.keys, *([SALT] if spread else [])], "left").drop(SALT)
                  .withColumn(SLICE, _slice_of(F.col("_cuts"), F.struct(*self.order)))
                  .withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts"))
        self.df = df

    @property
    def window(self):
        return Window.partitionBy(*self.keys, *([SLICE] if self.sliced else [])).orderBy(*self.order)

    def _carried(self, name: str, total: Column, over_slices) -> None:
        """Join what the earlier slices of a hot key hand on, as column `name`."""
        between = Window.partitionBy(*self.keys).orderBy(SLICE)
        carry = (self.df.where("_hot").groupBy(*self.keys, SLICE).agg(total.alias("_total"))
                 .withColumn(name, over_slices(F.col("_total"), between)).drop("_total"))
        self.df = self.df.join(carry, [*self.keys, SLICE], "left")

    def running_sum(self, value: Column, name: str, include_current: bool = True) -> KeyedOrder:
        """Sum of `value` up to this row."""
        self.df = self.df.withColumn("_value", value)
        end = Window.currentRow if include_current else -1
        local = F.sum("_value").over(self.window.rowsBetween(Window.unboundedPreceding, end))
        if not self.sliced:
            self.df = self.df.withColumn(name, F.coalesce(local, F.lit(0)))
        else:
            # Same column list for both branches, so the carry is computed from the sliced rows.
            self._carried("_carry", F.sum("_value"), lambda total, w: F.sum(total).over(
                w.rowsBetween(Window.unboundedPreceding, -1)))
            self.df = self.df.withColumn(
                name, F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry")
        self.df = self.df.drop("_value")
        return self

    def row_number(self, name: str) -> KeyedOrder:
        return self.running_sum(F.lit(1).cast("bigint"), name)

    def last_value(self, value: Column, name: str, include_current: bool = True) -> KeyedOrder:
        """Last non-null `value` up to this row."""
        self.df = self.df.withColumn("_value", value)
        end = Window.currentRow if include_current else -1
        local = F.last("_value", ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, end))
        if not self.sliced:
            self.df = self.df.withColumn(name, local)
        else:
            newest = F.max_by(F.when(F.col("_value").isNotNull(), F.struct("_value")),
                              F.when(F.col("_value").isNotNull(), F.struct(*self.order)))
            self._carried("_carry", newest, lambda total, w: F.last(total, ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1)))
            self.df = self.df.withColumn(name, F.coalesce(local, F.col("_carry._value"))).drop("_carry")
        self.df = self.df.drop("_value")
        return self

    def previous(self, value: Column, name: str) -> KeyedOrder:
        """`value` of the row before, null on the first row of a key. Null values are kept."""
        self.df = self.df.withColumn("_kept", F.struct(value.alias("_inner")))
        self.last_value(F.col("_kept"), "_found", include_current=False)
        self.df = self.df.withColumn(name, F.col("_found._inner")).drop("_kept", "_found")
        return self

    def result(self) -> DataFrame:
        return self.df.drop(SLICE, "_hot")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int,
                  rank: str | None = None) -> DataFrame:
    """The first `count` rows of every key.

    Spark keeps only `count` rows per key and task before the shuffle (window group limit), so a hot key
    sends no more than that from each task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    top = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= count)
    return top if rank else top.drop(name)

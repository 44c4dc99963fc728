"""Hard negatives by Fagin's threshold algorithm.

Vectors become rows of integers. All rows are numbered in order of their length and label and dealt to tiles; a tile keeps, for each
dimension, its rows sorted by that component. An anchor reads the lists of a tile in step, from the top where its own
component is positive and from the bottom where it is negative, and scores every row it meets by the whole integer product. What no
list has shown yet scores at most the sum of the anchor's components times the last values read; reading ends once this threshold is
strictly below what each of the anchor's windows still needs. The best rows of the tiles are merged in Spark.

The anchors are a stated set of queries and meet all rows, tile by tile; a tile is held once and anchors stream past it, so memory does
not grow with the number of either. A label with a third of all rows has its tiles like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockroom.llm.common import lean, written
from stockroom.operators.keyed import first_per_key
from stockroom.operators.numbering import numbered

#: Rows of a tile.
TILE = 16_384
#: Rows read from each list at first; every further step reads twice as many.
STEP = 64


class Tile:
    """Rows of one length with a sorted list per dimension."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, numbers: np.ndarray, labels: np.ndarray):
        self.matrix, self.ids, self.numbers, self.labels = matrix, ids, numbers, labels
        self.largest = max(1, int(np.abs(matrix).max(initial=0)))
        self.lists = np.argsort(matrix, axis=0, kind="stable")  # smallest first
        self.exact = {np.int64: matrix}

    def as_kind(self, anchor: np.ndarray) -> np.ndarray:
        """The rows in the fastest kind of number in which products with this anchor are exact."""
        most = self.largest * max(1, int(np.abs(anchor).max(initial=0))) * max(1, len(anchor))
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        if kind not in self.exact:
            self.exact[kind] = self.matrix.astype(kind)
        return self.exact[kind]


def threshold_top(tile: Tile, anchor: np.ndarray, eligible: np.ndarray, low: list, high: list, count: int) -> list[np.ndarray]:
    """For every window [low, high] the indices of its first `count` eligible rows, by score and then by id."""
    matrix = tile.as_kind(anchor)
    a = anchor.astype(matrix.dtype)
    size, dims = len(matrix), np.flatnonzero(anchor)
    down = anchor[dims] > 0
    scores, seen = np.zeros(size, matrix.dtype), np.zeros(size, bool)
    depth, step = 0, STEP
    if not len(dims):  # every score is 0
        seen[:] = True
    while not seen.all():
        depth = min(size, depth + step)
        step *= 2
        met = np.zeros(size, bool)
        met[tile.lists[size - depth:, dims[down]].ravel()] = True
        met[tile.lists[:depth, dims[~down]].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        scores[new] = matrix[new] @ a
        seen[new] = True
        last = np.where(down, tile.lists[size - depth, dims], tile.lists[depth - 1, dims])
        threshold = matrix[last, dims] @ a[dims]
        if all(threshold < need for need in _needs(scores[seen & eligible], low, high, count)):
            break
    found = []
    for lo, hi in zip(low, high):
        inside = np.flatnonzero(seen & eligible & (scores >= lo) & (scores <= hi))
        if len(inside) > count:  # only those that reach the last place take part in the sort
            inside = inside[scores[inside] >= np.partition(scores[inside], -count)[-count]]
        order = np.lexsort((tile.numbers[inside], tile.ids[inside], -scores[inside]))
        found.append(inside[order[:count]])
    return found


def _needs(scores: np.ndarray, low: list, high: list, count: int) -> Iterator:
    """What an unseen row must score to enter each window: the last place's score, or the window's lower end while places are free."""
    for lo, hi in zip(low, high):
        inside = scores[(scores >= lo) & (scores <= hi)]
        yield np.partition(inside, -count)[-count] if len(inside) >= count else lo


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _searched(rows: DataFrame, asked: DataFrame, same_label: bool, count: int) -> DataFrame:
    """Meet anchors with tiles. `rows`: tile, number, vec_id, label, size, v. `asked`: the same of the anchors, per tile, with `low` and `high`
    (arrays, one element per window). Gives (number, window, score, vec_id, found): the first `count` of each tile and window."""
    columns = ["tile", "asking", "number", "vec_id", "label", "size", "v", "low", "high"]
    none = F.lit(None).cast("array<bigint>")
    both = rows.select("tile", F.lit(False).alias("asking"), "number", "vec_id", "label", "size", "v", none.alias("low"), none.alias("high")).union(
        asked.select("tile", F.lit(True).alias("asking"), "number", "vec_id", "label", "size", "v", "low", "high"))
    dealt = both.repartition("tile").sortWithinPartitions("tile", "asking", "size").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_no, waiting, tiles = None, [], {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = 0
            key = np.stack([table["tile"].to_numpy(), table["asking"].to_numpy().astype(np.int64), table["size"].to_numpy()])
            borders = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), table.num_rows]
            for border in map(int, borders):
                part, (tile, asking, size) = table.slice(at, border - at), key[:, at].tolist()
                at = border
                if tile != tile_no:
                    tile_no, waiting, tiles = tile, [], {}
                if not asking:
                    waiting.append((size, part))
                    continue
                if waiting:
                    for held in {s for s, _ in waiting}:
                        rows_of = pa.concat_tables([p for s, p in waiting if s == held]).combine_chunks()
                        tiles[held] = Tile(_matrix(rows_of["v"].combine_chunks(), rows_of.num_rows), *(
                            rows_of[c].to_numpy() for c in ("vec_id", "number", "label")))
                    waiting = []
                if size in tiles:
                    yield _answers(tiles[size], part, same_label, count)

    return dealt.mapInArrow(lean(run), "number long, window int, score long, vec_id long, found long")


def _answers(tile: Tile, part: pa.Table, same_label: bool, count: int) -> pa.RecordBatch:
    out: list[tuple] = []
    anchors = _matrix(part["v"].combine_chunks(), part.num_rows)
    for i, (number, label, low, high) in enumerate(zip(*(part[c].to_pylist() for c in ("number", "label", "low", "high")))):
        eligible = (tile.labels == label) & (tile.numbers != number) if same_label else tile.labels != label
        if not eligible.any():
            continue
        products = tile.as_kind(anchors[i])
        a = anchors[i].astype(products.dtype)
        for w, best in enumerate(threshold_top(tile, anchors[i], eligible, low, high, count)):
            out += [(number, w, int(s), int(tile.ids[r]), int(tile.numbers[r])) for r, s in zip(best, products[best] @ a)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*out) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["number", "window", "score", "vec_id", "found"])


def whole_vectors(df: DataFrame, label: Column, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, size, v): the rows that take part, their components as whole numbers."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.size(v).alias("size"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.where("vec_id is not null and label is not null")


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first `positives` other rows of the same label; its negatives for a positive are the first `negatives` rows of
    other labels with `low` to `high` per cent of the positive's score. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part; vectors of different lengths
    do not meet. Rows that repeat an id are rows of their own, as anchors too. Scores must fit 64 bits. A positive with a score of zero
    takes negatives with a score of zero; one below zero has none. An empty table gives no rows; other columns are not looked at.
    """
    rows = numbered(whole_vectors(df, label, vector), ["size", "label", F.xxhash64("vec_id", "v"), "vec_id"], "number")
    rows = written(rows.withColumn("tile", F.expr(f"(number - 1) div {TILE}")), "vectors")
    anchors = rows.where(is_anchor)
    bounds = [F.min("tile").alias("_from"), F.max("tile").alias("_to")]
    tiles = F.explode(F.sequence("_from", "_to")).alias("tile")
    columns = ["number", "vec_id", "label", "size", "v"]

    whole = F.array(F.lit(-2 ** 63).cast("bigint")).alias("low"), F.array(F.lit(2 ** 63 - 1).cast("bigint")).alias("high")
    own = anchors.join(rows.groupBy("size", "label").agg(*bounds), ["size", "label"]).select(*columns, tiles, *whole)
    best = written(_searched(rows, own, True, positives), "positives")
    best = first_per_key(best, ["number"], [F.desc("score"), F.col("vec_id"), F.col("found")], positives, "_rank")
    # The window as whole numbers: 100 n >= low p and 100 n <= high p.
    windows = best.select("number", F.struct(
        "_rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"ceil(cast({low} * score as decimal(30, 0)) / 100)").cast("bigint").alias("low"),
        F.expr(f"floor(cast({high} * score as decimal(30, 0)) / 100)").cast("bigint").alias("high")).alias("w")).where("w.low <= w.high")
    windows = written(windows.groupBy("number").agg(F.array_sort(F.collect_list("w")).alias("w")), "windows")  # at most `positives` each
    asked = anchors.join(windows, "number").join(rows.groupBy("size").agg(*bounds), "size").select(
        *columns, tiles, F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = first_per_key(_searched(rows, asked, False, negatives), ["number", "window"],
                          [F.desc("score"), F.col("vec_id"), F.col("found")], negatives, "rank")
    named = windows.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number").select(
        "number", "anchor_id", F.posexplode("w").alias("window", "w"))
    return found.withColumnRenamed("vec_id", "negative_id").join(named, ["number", "window"]).select(
        "anchor_id", "w.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "w.positive_score", F.col("score").alias("negative_score"))

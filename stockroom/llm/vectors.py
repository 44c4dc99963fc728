"""Near-duplicate vectors within a label: quantised tile products with error bounds.

Equal vectors of a label are one class. The classes of a label are dealt over blocks, and every two blocks meet in one tile. In a
tile the unit vectors are rounded to 8-bit integers with a scale each; what rounding takes off is measured per vector, which
bounds the error of each product. Only pairs whose product plus bound reaches the threshold are computed in double
precision. A tile reports how many vectors each class is linked with and a spanning set of its links, never all pairs, so groups of
copies cost rows in proportion to their size. A label with a third of all rows is split like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import written
from stockroom.llm.graph import components

#: Vectors of a block, about.
BLOCK = 2048
#: Pairs that are recomputed at once.
PAIRS = 1 << 18


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scales, and the length of what rounding takes off each vector."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    return whole, scale, np.linalg.norm(unit - whole * scale[:, None], axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at least `least`, exactly; with `same` only those of a smaller with a larger index."""
    units = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (left, right)]
    (q1, s1, e1), (q2, s2, e2) = map(quantised, units)
    # Products of 8-bit integers are exact in single precision while their sums stay below 2^24.
    kind = np.float32 if left.shape[1] <= 1000 else np.float64
    product = (q1.astype(kind) @ q2.astype(kind).T).astype(np.float64) * s1[:, None] * s2[None, :]
    product += (1 + e1[:, None]) * e2[None, :] + e1[:, None]
    near = product >= least - 1e-9
    if same:
        near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    a, b = np.nonzero(near)
    found = np.zeros(len(a), bool)
    for low in range(0, len(a), PAIRS):
        x, y = left[a[low:low + PAIRS]], right[b[low:low + PAIRS]]
        cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        found[low:low + PAIRS] = cosine >= least
    return a[found], b[found]


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def near_vectors(df: DataFrame, least: float = 0.93, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `df` (vec_id, label, vector).

    Vectors without a label, null, empty, zero, or with null or non-finite components link with nothing and stay; so do vectors of
    different lengths with each other. Repeated rows are vectors of their own (they link). The component of null ids only has a null
    component_id, and rows without an id are not kept beside others. An empty table gives no rows.
    """
    v = F.col(vector)
    good = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(
        F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select("vec_id", "label", F.when(good, v.cast("array<double>")).alias("v"))
    group = F.struct("label", F.size("v").alias("size"))
    known = rows.where("v is not null").select("vec_id", group.alias("label"), "v", F.xxhash64("label", "v").alias("class"))
    classes = written(known.groupBy("label", "v", "class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")), "classes")
    blocks = classes.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.select("label", "class", "v", "copies").join(blocks, "label").withColumn(
        "block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    met = dealt.select("label", "class", "v", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "copies", "v")

    def tile(table: pa.Table) -> pa.Table:
        block, label = table.column("block").to_numpy(), table.column("class").to_numpy()
        copies = table.column("copies").to_numpy()
        values = table.column("v").combine_chunks()
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        first, last = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == last)
        a, b = tile_links(matrix[rows], matrix[columns], least, first == last) if len(rows) and len(columns) else (rows[:0], rows[:0])
        a, b = rows[a], columns[b]
        links = np.bincount(a, copies[b], len(block)) + np.bincount(b, copies[a], len(block))
        linked = np.flatnonzero(links)
        root = _roots(len(block), a, b)
        return pa.table({"class": label[linked], "links": links[linked].astype(np.int64), "other": label[root[linked]]},
                        schema=pa.schema([("class", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))

    found = written(met.groupBy("label", "i", "j").applyInArrow(tile, "class long, links long, other long"), "tiles")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "class")
    named = classes.select("class", "first", "copies").join(links, "class", "left").join(roots, "class", "left").select(
        "class", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "class").alias("root"))
    named = written(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(smallest, "root").select("class", "n_links", "component_id"), "named")
    linked = known.select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

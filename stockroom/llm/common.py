"""Helpers that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stockroom.session import shared_dir, work_path, written

#: The object that a Python worker keeps between tasks (a tokenizer, a model): the last one it needed.
_KEPT: dict = {}


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table of the corpus; other columns are never looked at."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def kept(kind: str, key: str, make: Callable):
    """`make()`, done once per worker process while no other object is asked for."""
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def only_kept(kind: str | None) -> None:
    """Let go of what this worker kept for tasks of other kinds."""
    for key in [k for k in _KEPT if k[0] != kind]:
        del _KEPT[key]


def lean(run: Callable, uses: str | None = None) -> Callable:
    """A function over batches that gives its memory back to the system when a task ends: workers outlive tasks.

    `uses` is the kind of object it asks `kept` for; objects of other kinds go before it starts.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_kept(uses)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def strings(column: pa.Array) -> list[str]:
    """The values of a string column; null counts as the empty text."""
    values = column.to_pylist()
    return values if column.null_count == 0 else [v or "" for v in values]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offset of each value (one more than values).

    Null counts as the empty text.
    """
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of values of about `limit` bytes together (a longer value stands alone), so that arrays per byte stay small."""
    low, count = 0, len(offsets) - 1
    while low < count:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, count)
        low = min(high, count)


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle of rows of `df`'s size: as many as the session asks for, never fewer than `least`."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


__all__ = ["kept", "lean", "partitions", "read", "shared_dir", "slices", "strings", "text_bytes", "work_path", "written"]

"""What lies under a prefix, for all prefixes of a table of texts at once.

In sorted order the texts that start with a given text stand right behind it. Texts are sorted into ranges once; each range is walked
with the stack of texts that are prefixes of the current one, so a row costs one step however long it is. A prefix that is still
open where its range ends goes on into the next ranges; for that each range tells what its first rows hold. Per range these are as many
entries as a text has letters, and only they pass through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.numbering import RANGE, in_ranges
from stockroom.session import written

_SCHEMA = f"{RANGE} int, kind string, text string, size int, lowest long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, text, id) sorted by range and text. Gives the lowest id under each `closed` text, the texts `open` at the end of the
    range, what its `lead` holds (the lowest id under the first `size` letters of its first text), and its `first` and `last` text."""
    out: list[tuple] = []
    at = first = last = None
    stack: list[list] = []
    shared, low = 0, 0

    def finish() -> None:
        out.append((at, "lead", first, shared, low))
        out.append((at, "first", first, 0, 0))
        out.append((at, "last", last, 0, 0))
        while stack:
            close("open")

    def close(kind: str) -> None:
        text, lowest = stack.pop()
        out.append((at, kind, text, len(text), lowest))
        if stack:
            stack[-1][1] = min(stack[-1][1], lowest)

    for batch in batches:
        for here, text, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != at:
                if at is not None:
                    finish()
                at, first, shared, low = here, text, len(text), number
            common = len(os.path.commonprefix([first, text]))
            if common < shared:
                out.append((at, "lead", first, shared, low))
                shared = common
            low = min(low, number)
            while stack and not text.startswith(stack[-1][0]):
                close("closed")
            stack.append([text, number])
            last = text
        yield _batch(out)
        out.clear()
    if at is not None:
        finish()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[RANGE, "kind", "text", "size", "lowest"])


def carried(borders: list[tuple]) -> list[tuple[str, int]]:
    """(text, lowest) for texts that are open at the end of a range: what the ranges behind it hold under them."""
    ranges: dict[int, dict] = {}
    for at, kind, text, size, lowest in borders:
        held = ranges.setdefault(at, {"lead": [], "open": []})
        if kind in ("first", "last"):
            held[kind] = text
        elif kind == "lead":
            held["lead"].append((size, lowest))
        else:
            held["open"].append((text, lowest))
    found, still = [], {}  # open texts that the next range may go on with
    for _, held in sorted(ranges.items()):
        for text in [t for t in still if not held["first"].startswith(t)]:
            del still[text]
        for text in still:
            # The shortest lead that is still at least as long as the text.
            _, lowest = min((lead for lead in held["lead"] if lead[0] >= len(text)), key=lambda lead: lead[0])
            found.append((text, lowest))
        for text in [t for t in still if not held["last"].startswith(t)]:
            del still[text]
        still.update(dict.fromkeys(t for t, _ in held["open"]))
    return found


def lowest_under(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """(text, lowest): for every distinct text of `df` (text, number) the lowest number of all rows whose text starts with it.

    Rows without a text are left out. An empty table gives no rows.
    """
    single = df.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("number").alias("number"))
    ranged = in_ranges(single, ["text"], ranges)
    sorted_rows = ranged.repartition(RANGE).sortWithinPartitions(RANGE, "text").select(RANGE, "text", "number")
    walked = written(sorted_rows.mapInArrow(_walk, _SCHEMA), "walked")
    borders = [tuple(r) for r in walked.where("kind <> 'closed'").collect()]  # a few per range
    more = df.sparkSession.createDataFrame(carried(borders), "text string, lowest long")
    return walked.where("kind in ('closed', 'open')").select("text", "lowest").union(more).groupBy("text").agg(F.min("lowest").alias("lowest"))

"""Writing documents and report exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from stockroom.operators.numbering import RANGE, numbered


def write_documents(df: DataFrame, path: str, form: str = "json") -> None:
    """Nested rows as JSON lines, or Parquet with nested columns."""
    df.write.mode("overwrite").format(form).save(path)


def write_report(rows: DataFrame, order: Sequence[Column], header: DataFrame, path: str, form: str = "csv",
                 ranges: int | None = None) -> None:
    """A report: all its rows, numbered in order (`row_no`), and its header, side by side. No row cap.

    The rows are sorted range by range, never in one task, and each range of numbers is a folder of its own: `part=0` holds the first.
    """
    numbered_rows = numbered(rows, order, "row_no", ranges=ranges, keep_range=True).withColumnRenamed(RANGE, "part")
    for part, writer in (("rows", numbered_rows.write.partitionBy("part")), ("header", header.write)):
        writer = writer.mode("overwrite").format(form)
        if form == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path}/{part}")

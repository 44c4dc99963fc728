import pytest
from pyspark.sql import functions as F

from stockroom.operators.numbering import numbered


@pytest.mark.parametrize("ranges", [1, 7])
def test_numbers_and_sums(spark, ranges):
    rows = [(i * 37 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    got = sorted((r.n, r.k, r.total) for r in numbered(df, [F.desc("k")], "n", {"total": F.col("v").cast("long")}, ranges).collect())
    want, total = [], 0
    for n, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        total += v
        want.append((n, k, total))
    assert got == want


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 1), (None, 1)], "k int, v int")
    assert sorted((r.row_number, r.k) for r in numbered(df, ["k"]).collect()) == [(1, None), (2, None), (3, 2), (4, 2)]
    assert numbered(df.limit(0), ["k"]).collect() == []

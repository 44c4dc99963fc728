import random

import pytest
from pyspark.sql import functions as F

from stockroom.operators.prefixes import lowest_under
from stockroom.plans.slugs import assign_slugs


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_lowest_under_against_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    rows = [("".join(rng.choice("ab-é") for _ in range(rng.randint(0, 6))), rng.randint(-50, 500)) for _ in range(300)]
    rows += [("a" * n, 900 + n) for n in range(40)] + [(None, 1), ("long" * 500, 7), ("long" * 499, 8)]
    got = dict(map(tuple, lowest_under(spark.createDataFrame(rows, "text string, number long"), ranges).collect()))
    known = [r for r in rows if r[0] is not None]
    assert got == {t: min(n for u, n in known if u.startswith(t)) for t, _ in known}


def test_empty(spark):
    assert lowest_under(spark.createDataFrame([], "text string, number long")).collect() == []


def test_plan_spreads_no_row_over_its_letters(spark):
    new = spark.createDataFrame([(1, "A B"), (2, "A"), (3, "A B"), (4, "C")], "id long, name string")
    existing = spark.createDataFrame([("c-d",), (None,)], "slug string")
    made = assign_slugs(new, existing, ranges=2)
    assert "Generate" not in made._jdf.queryExecution().toString()
    assert dict(made.select("id", "slug").collect()) == {1: "a-b", 2: "a-2", 3: "a-b-3", 4: "c-4"}
    assert made.where(F.col("id") == 9).count() == 0

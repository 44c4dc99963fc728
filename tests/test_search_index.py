import random

import pytest

from stockroom.operators.filters import search
from stockroom.sources.search_index import save_search, search_saved


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["Ring", "ring-bolt", "ÉCLAIR", "éclair", "x", "", "a%b_c", "Wing nut", "rin g"]
    rows = [(i, rng.choice(words) + rng.choice(["", " ", "-"]) + rng.choice(words), rng.choice([None, *words])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, sku string")
    path = str(tmp_path_factory.mktemp("search"))
    save_search(df, "id", ["name", "sku"], path, 8)
    return df, path


@pytest.mark.parametrize("term", ["ring", "RING-B", "écl", "éclair", "%b_", "g n", "in", "x", "", None, "no such thing", "rin grin"])
def test_finds_what_the_scan_finds(spark, shop, term):
    df, path = shop
    got = search_saved(spark, "id", path, term, ["name", "sku"], 8)
    want = search(df, term, ["name", "sku"], ascii_only=True)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_reads_candidates_only(spark, shop):
    _, path = shop
    plan = search_saved(spark, "id", path, "ring-b", ["name", "sku"], 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "postings" not in search_saved(spark, "id", path, "ri", ["name"], 8)._jdf.queryExecution().toString()


def test_empty(spark, shop, tmp_path):
    df, _ = shop
    save_search(df, "id", ["name"], str(tmp_path), 4)
    assert search_saved(spark, "id", str(tmp_path), "zzz", ["name"], 4).count() == 0

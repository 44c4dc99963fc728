import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import negatives
from stockroom.llm.queries import ORACLE, op12_hard_negatives


def brute(rows, every=3, positives=2, count=4, low=30, high=90):
    good = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(good):
        if i % every:
            continue
        others = [(-dot(v, w), j, m) for n, (j, m, w) in enumerate(good) if n != k and len(w) == len(v)]
        for p, pid, _ in sorted(o for o in others if o[2] == label)[:positives]:
            inside = sorted(o for o in others if o[2] != label and low * -p <= 100 * -o[0] <= high * -p)[:count]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(inside, 1)]
    return sorted(out)


def rows_of(seed, n=300, dims=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dims))
    rows = [(int(i), int(rng.integers(0, 3)) if i % 4 else 0, (base[rng.integers(0, 12)] * rng.choice([1, 1, 0.5]) + rng.choice([0, 0, 0.3]) * rng.normal(size=dims)).tolist())
            for i in range(n)]
    bad = [(3000, None, rows[0][2]), (3003, 1, None), (3006, 1, []), (3009, 1, [float("inf")] * dims), (3012, 1, [None] + [1.0] * (dims - 1)),
           (3015, 1, [float("nan")] * dims), (None, 1, rows[0][2])]
    return rows + rows[:6] + bad + [(3018, 1, [0.0] * dims), (3021, 2, [1.0, -2.0]), (3022, 2, [1.5, -2.0]), (3023, 0, [1.0, -1.0])]


@pytest.mark.parametrize("tile", [20, 16_384])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit(1))
    got = negatives.hard_negatives(df, F.expr("vec_id % 3 = 0"), F.col("label"), 2, 4)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("kind", [1, 10 ** 7, 10 ** 12])
def test_threshold_stops_in_time_and_misses_nothing(kind, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 2)
    rng = np.random.default_rng(2)
    matrix = np.floor(rng.normal(size=(400, 5)) ** 3 * 20).astype(np.int64) * kind
    ids, labels = rng.integers(0, 90, 400), rng.integers(0, 2, 400)
    tile = negatives.Tile(matrix, ids, np.arange(400), labels)
    for anchor in [*matrix[:20], np.zeros(5, np.int64), -matrix[3]]:
        scores = [sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in matrix]
        top = max(scores)
        low, high = [-2 ** 62, top * 3 // 10, 0], [2 ** 62, top * 9 // 10, 0]
        got = negatives.threshold_top(tile, anchor, labels == 1, low, high, 7)
        for g, lo, hi in zip(got, low, high):
            want = sorted((-s, ids[i], i) for i, s in enumerate(scores) if labels[i] == 1 and lo <= s <= hi)[:7]
            assert [(-scores[i], ids[i], i) for i in g] == want


def test_reads_less_than_all(monkeypatch):
    """Where one component decides, a few rows of each list are enough."""
    matrix = np.stack([np.arange(5000), np.arange(5000) % 3], axis=1).astype(np.int64)
    tile = negatives.Tile(matrix, np.arange(5000), np.arange(5000), np.zeros(5000, np.int64))
    scored = []
    monkeypatch.setattr(negatives, "_needs", lambda s, *rest, plain=negatives._needs: scored.append(len(s)) or plain(s, *rest))
    found = negatives.threshold_top(tile, np.array([5, 1]), np.ones(5000, bool), [0], [10 ** 9], 3)
    assert found[0].tolist() == [4999, 4998, 4997] and scored[-1] < 1000


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, F.expr("vec_id % 100 = 0"), F.col("label")).count() == 0


def test_whole_table_by_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert {tuple(r) for r in op12_hard_negatives(spark, sf_dir).collect()} == set(duckdb.sql(ORACLE["op12_hard_negatives"]).fetchall())

import numpy as np
import pytest

from stockroom.llm import vectors
from stockroom.llm.queries import ORACLE, op10_embedding_dedup
from test_simhash import roots


def cosines(a, b):
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def test_bounds_miss_nothing():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.repeat(base, 5, axis=0) + rng.normal(size=(200, 16)) * rng.choice([0, 0.1, 0.4, 5], (200, 1))
    for least in (0.5, 0.93, 0.999):
        a, b = vectors.tile_links(x, x, least, True)
        want = np.argwhere(np.triu(cosines(x, x) >= least, 1))
        assert set(zip(a.tolist(), b.tolist())) == set(map(tuple, want.tolist()))


@pytest.mark.parametrize("block", [7, 2048])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 8))
    rows, inf, nan = [], float("inf"), float("nan")
    for i in range(160):
        v = base[rng.integers(0, 25)] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.3])
        rows.append((i * 3, [float(np.float32(t)) for t in v], int(i % 3)))
    rows += [(1000, rows[5][1], None), (1001, None, 1), (1002, [0.0] * 8, 1), (1003, [inf] + [1.0] * 7, 1), (1004, [nan] * 8, 1),
             (1005, [None] + [1.0] * 7, 1), (1006, [], 1), (1007, rows[5][1], rows[5][2]), (1008, [2 * t for t in rows[5][1]], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [r for r in rows if r[0] < 1000 or r[0] > 1006]
    x, label = np.array([r[1] for r in good]), np.array([r[2] for r in good])
    near = (cosines(x, x) >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in good]
    root = roots([r[0] for r in rows], [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    links = dict(zip(ids, near.sum(axis=1).tolist()))
    got = {tuple(r) for r in vectors.near_vectors(df).collect()}
    assert got == {(i, links.get(i, 0), root[i], root[i] == i) for i in root}


def test_odd_ids(spark):
    rows = [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, [5.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)], key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_whole_table_by_sql(spark, sf_dir):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert {tuple(r) for r in op10_embedding_dedup(spark, sf_dir).collect()} == set(duckdb.sql(ORACLE["op10_embedding_dedup"]).fetchall())

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stockroom.llm import ngrams
from stockroom.llm.queries import op2_lm_scoring


def words_of(text):
    return (text or "").encode().lower().split() + [None]


def plain(rows):
    """Base scores by dictionaries, and model scores with the counts rounded to their levels."""
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    one, two, docs = Counter(), Counter(), 0
    for d, text in rows:
        if not held[d]:
            w = words_of(text)
            docs += 1
            one.update(w)
            two.update(zip(["start", *w], w))
    n, v = sum(one.values()), len(one)
    out = []
    for d, text in rows:
        w = words_of(text)
        p = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = 0.0
        for h, x, q in zip(["start", *w], w, p):
            ch = docs if h == "start" else one[h]
            c = two[h, x]
            c = min(ngrams.VALUES[np.searchsorted(ngrams.LEVELS, c, "right")], ch, one[x])
            k = 5 * ch ** 0.8 + 2
            score += math.log10((c + k * q) / (ch + k))
        out.append((d, held[d], len(w), sum(one[x] > 0 for x in w), n, pytest.approx(sum(map(math.log10, p)), abs=1e-6),
                    pytest.approx(score, abs=1e-6)))
    return out


def test_filter_has_every_count():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)
    counts = np.maximum(1, rng.pareto(0.6, len(keys)).astype(np.int64)).clip(max=10 ** 7)
    at = ngrams.range_of(keys, 16)
    bits = 64 * 1024
    data = [ngrams.segment(keys[at == r], counts[at == r], bits).tobytes() for r in range(16)]
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    data = [b"".join(data[r:r + 6]) for r in range(0, 16, 6)]
    found = ngrams.found_counts(data, keys, 16, bits)
    want = ngrams.VALUES[np.searchsorted(ngrams.LEVELS, counts, "right")]
    assert (found >= want).all() and (found == want).mean() > 0.95
    assert (ngrams.found_counts(data, np.sort(rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)), 16, bits) > 0).mean() < 0.05


def test_against_dictionaries(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 20_000)  # many blocks
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, op2_lm_scoring(spark, sf_dir).collect()))
    assert got == sorted(plain(rows), key=lambda r: r[0])


def test_filter_grows_with_the_pairs():
    """Seen pairs keep their level and unseen ones have none, however small the filter may begin."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2 ** 64, 200_000, dtype=np.uint64))
    counts = np.where(np.arange(len(keys)) % 2, np.maximum(1, rng.pareto(0.6, len(keys)).astype(np.int64)).clip(max=10 ** 7), 0)
    want = np.searchsorted(ngrams.LEVELS, counts, "right")
    found = ngrams.found_levels(keys, counts, 64)
    assert (found >= want).all() and (found != want).mean() < 0.005


def test_small_filter_keeps_the_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.score for r in ngrams.score_documents(docs).collect()}
    got = {r.doc_id: r.score for r in ngrams.score_documents(docs, filter_mb=0).collect()}
    assert max(abs(got[d] / want[d] - 1) for d in want) < 0.01


def test_edge_rows(spark):
    rows = [(1, "A b\tB"), (1, "a"), (None, "b b"), (2, None), (3, ""), (9, "x " * 60_000), (4, "é\x1cq É")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngrams.score_documents(df, filter_mb=1).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[2])) == sorted(plain(rows), key=lambda r: (str(r[0]), r[2]))
    assert ngrams.score_documents(df.limit(0), filter_mb=1).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = ngrams.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), filter_mb=1).first()
    assert only.train_tokens == 0 and only.score == pytest.approx(only.base_score)


def test_held_out_texts_are_likelier(spark):
    rows = op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score > r.base_score for r in rows) > 0.75 * len(rows)
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)

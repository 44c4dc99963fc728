import hashlib

import numpy as np
import pytest

from stockroom.llm import minhash
from stockroom.llm.queries import op7_minhash


def plain_shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingles_are_those_of_the_words(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", "b", "x\ty", "\n", "Ü z"], rng.integers(0, 12))) for _ in range(400)]
    texts += ["", " ", "w " * 400, "long" * 9000]
    hashes = {}
    for size in (1 << 18, 64):
        monkeypatch.setattr(minhash, "SLICE", size)
        raw = [t.encode() for t in texts[:-1]]
        value, number = minhash.shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        parts = np.split(value, np.cumsum(number)[:-1])
        for text, part in zip(texts, parts):
            want = plain_shingles(text)
            assert len(set(part.tolist())) == len(want)
            assert hashes.setdefault(frozenset(want), frozenset(part.tolist())) == frozenset(part.tolist())
    assert len(set(hashes.values())) == len(hashes)


def check(spark, df, rows):
    """Rows in descending order of id against brute force."""
    got = minhash.edited_likeness(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    marks = {}
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        r = by[doc, len(text), hashlib.sha256(changed.encode()).hexdigest()]
        for t, mark in ((text, r.fingerprint), (changed, r.edited_fingerprint)):
            assert marks.setdefault(t, mark) == mark
        assert abs(r.near_edited - jaccard(text, changed)) < 0.27 and abs(r.near_next - jaccard(text, after)) < 0.27
    return got


@pytest.mark.parametrize("ranges", [1, 4, 30])
def test_edge_rows(spark, monkeypatch, ranges):
    monkeypatch.setattr(minhash, "partitions", lambda df: ranges)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "de", "ü"], 40))) for i in range(-5, 60, 3)]
    rows += [(10 ** 15, None), (10 ** 15 - 1, ""), (10 ** 15 - 2, "word " * 70_000), (None, "ünter " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(spark, df, sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))
    check(spark, df.where("doc_id = 4"), [r for r in rows if r[0] == 4])
    assert minhash.edited_likeness(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert minhash.edited_likeness(twice).count() == 3


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = sorted(((d.doc_id, d.text) for d in docs), reverse=True)
    got = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)
    assert {tuple(r) for r in op7_minhash(spark, sf_dir).collect()} == {tuple(r) for r in got}
    long = [r for r in got if r.n_chars > 3000]
    assert min(r.near_edited for r in long) > 0.25 and sum(r.near_next for r in long) / len(long) < 0.1


def test_near_duplicates_by_brute_force(spark, sf_dir):
    from test_simhash import roots
    rng = np.random.default_rng(8)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(40):  # chains of ever more edited copies
        words = docs[i % 4][1].split(" ")[:200 + i]
        for at in rng.integers(0, len(words), i // 8):
            words[at] = f"new{i}"
        docs.append((1000 + i, " ".join(words)))
    docs += [(2000, None), (2001, " \n"), (None, docs[0][1])]
    sets = [plain_shingles(t or "") for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (
        len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8]
    root = roots(range(len(docs)), links)
    first = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            first[root[k]] = min(first.get(root[k], i), i)
    want = sorted(((i, first.get(root[k])) for k, (i, _) in enumerate(docs)), key=str)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == want
    assert minhash.near_duplicates(df.limit(0)).count() == 0

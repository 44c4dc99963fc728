import hashlib

import numpy as np
import pytest

from stockroom.llm import suffixes
from stockroom.llm.queries import op6_suffix_dedup


def plain(rows, span):
    """Brute force over documents in order: (bytes, removed, spans, digest) by (doc_id, text)."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        cover = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - span + 1):
            part = data[i:i + span]
            if part in seen:
                cover[i + 1:i + 1 + span] = True
            else:
                seen.add(part)
        kept = bytes(b for b, c in zip(data, cover[1:-1]) if not c)
        spans = int((cover[1:] & ~cover[:-1]).sum())
        out[doc, text] = (len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, span=100):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = plain(rows, span)
    got = suffixes.remove_repeats(df, span).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == want[r.row.doc_id, r.row.text], r.row.doc_id
    return sum(w[1] for w in want.values())


def made_rows(seed, letters, sizes, shared):
    rng = np.random.default_rng(seed)

    def some(n):
        return "".join(rng.choice(list(letters), n))

    passages = [some(n) for n in shared]
    rows = []
    for i, n in enumerate(sizes):
        text = some(n)
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(0, len(passages))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            at = rng.integers(0, len(text) + 1)
            text = text[:at] + p[a:b] + text[at:]
        rows.append((i * 7 % 101 + i, text))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh é"), (3, "a"), (4, "abc")])
def test_random_texts(spark, seed, letters):
    rows = made_rows(seed, letters, [0, 1, 99, 100, 101, 150] + [300] * 60, [80, 100, 101, 140, 400, 700])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(df) > 0


def test_many_ranges_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "partitions", lambda df: 40)
    passage = "".join(np.random.default_rng(9).choice(list("abcdefghij "), 5000))
    rows = [(i, passage[i * 3:i * 3 + 400] + passage[:250] + "x" * 130) for i in range(60)]
    check(spark.createDataFrame(rows + [(100, "x" * 700_000), (101, passage * 150)], "doc_id long, text string"))


@pytest.mark.parametrize("ranges", [2, 5, 12])
def test_border_inside_copies_before_other_kinds(spark, monkeypatch, ranges):
    monkeypatch.setattr(suffixes, "partitions", lambda df: ranges)
    rows = [(5, 10, doc, 1) for doc in range(1, 41)] + [(5, 20, 99, 1), (6, 1, 100, 1), (7, 1, 101, 1)]
    got = suffixes.neighbours(spark.createDataFrame(rows, suffixes.RECORD), openers=True).collect()
    assert sorted(r.doc for r in got if r.kind == suffixes.OPEN) == [1, 99]
    assert sorted(r.doc for r in got if r.kind == suffixes.REPEAT) == list(range(2, 41))


def test_edge_rows(spark):
    long = "".join(np.random.default_rng(2).choice(list("abcdefghij "), 900))
    rows = [(1, None, "k"), (2, "", "k"), (3, long, "k"), (3, long, "k"), (3, long[100:] + "!", "m"), (None, "??" + long, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    got = suffixes.remove_repeats(df).collect()
    assert len(got) == 6 and {r.row.place for r in got} == {"k", "m", "p"}
    firsts = [r for r in got if r.row.text == long]
    assert len({(r.n_removed, r.kept_sha256) for r in firsts}) == 1
    none = next(r for r in got if r.row.doc_id is None)
    assert bytes(none.kept) == b"??" and none.spans[0].start == 2 and none.spans[0].end == 902
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 100)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_suffix_dedup(spark, sf_dir).collect()}
    assert got == {(d, *w) for (d, _), w in want.items()}

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from stockroom.llm import phrases
from stockroom.llm.queries import ORACLE, op11_phrase_mining


def brute(rows, least, longest, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), k, f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, k, left, right) in enumerate(sorted(scored)[:first], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -score, k))
    return out


def corpus():
    rng = random.Random(3)
    words = ["the", "a", "Of", "naïve", "x y", "ÀB", "z\x1cq", "end"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " , ", "-"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", "new york city hall now", "New York City"])))
    return rows + [("en", None), (None, ""), ("en", "." * 50), ("fr", "one two " * 3000), ("fr", "one two " * 3000), ("nl", "\t \x0c")]


@pytest.mark.parametrize("shards, least, longest", [(1, 5, 5), (40, 3, 5), (15, 2, 3), (15, 2, 2)])
def test_against_brute_force(spark, shards, least, longest):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(shards)  # every partition makes its own
    got = {tuple(r) for r in phrases.collocations(df, least, longest, first=40).collect()}
    assert got == brute(rows, least, longest, 40)


def test_shards_and_cuts(monkeypatch):
    monkeypatch.setattr(phrases, "SPLIT_BYTES", 10)
    text = b"aaa bbb, ccc ddd. eee fff ggg hhh iii jjj kkk; l"
    parts = list(phrases._cuts(text))
    assert b"".join(parts) == text and len(parts) > 1 and all(p.endswith((b",", b".", b";")) for p in parts[:-1])


@pytest.mark.parametrize("symbols", [3, 40, 70_000])
def test_intervals_against_plain_counts(symbols):
    rng = np.random.default_rng(symbols)
    sequence = np.concatenate([[0], rng.integers(0, min(symbols, 6) + 1, 400), [0]]).astype(np.int32)
    numbers = np.arange(1, symbols + 1)
    index = phrases.Index(*phrases.build(sequence, numbers, 4))
    held = index.words()
    for length in range(2, 6):
        held = index.longer(*held)
        plain = Counter(tuple(sequence[i:i + length].tolist()) for i in range(len(sequence) - length + 1))
        want = {p: c for p, c in plain.items() if 0 not in p}
        assert dict(zip(map(tuple, held[0].tolist()), held[1].tolist())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_whole_table_by_sql(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert {tuple(r) for r in op11_phrase_mining(spark, folder).collect()} == set(duckdb.sql(ORACLE["op11_phrase_mining"]).fetchall())


def test_extensions_in_portions_are_the_same_in_less_memory(monkeypatch):
    import tracemalloc

    sequence = np.random.default_rng(5).zipf(1.3, 400_000).clip(0, 3000).astype(np.int32)
    index = phrases.Index(*phrases.build(sequence, np.arange(1, 3000), 4))
    words = index.words()
    whole = index.longer(*words)
    tracemalloc.start()
    try:
        monkeypatch.setattr(phrases, "EXTENDED_ROWS", 20_000)
        portions = index.longer(*words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(whole, portions))
    assert whole[0].shape == (len(whole[1]), 2) and sum(map(len, whole)) > 0
    assert peak < 2 * sum(column.nbytes for column in portions) + 15 * len(sequence)


@pytest.mark.parametrize("least_ranges, range_words", [(32, 8_000_000), (1, 1_000)])
def test_shards_send_only_frequent_pairs(spark, monkeypatch, least_ranges, range_words):
    """Every word is frequent here, and one pair of words."""
    monkeypatch.setattr(phrases, "LEAST_RANGES", least_ranges)
    monkeypatch.setattr(phrases, "RANGE_WORDS", range_words)
    rng, tables, written = random.Random(7), {}, phrases.written

    def seen(df, name, **options):
        tables[name] = written(df, name, **options)
        return tables[name]

    monkeypatch.setattr(phrases, "written", seen)
    rows = [("en", " ".join([*(f"w{rng.randrange(400)}" for _ in range(40)), "new", "york"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(df, 10, 5, 40).collect()}
    assert got == brute(rows, 10, 5, 40) and len(got) == 1
    assert tables["words"].count() > 390
    shards = tables["shards"].where("not is_node").count()
    assert tables["pairs"].where("is_node").count() == shards  # one pair
    assert tables["left"].where("is_node").count() == 2 * shards  # its words


def test_cut_shards_keep_what_is_linked():
    rng = np.random.default_rng(2)
    sequence = np.concatenate([[0], rng.integers(0, 30, 5000), [0]]).astype(np.int32)
    words = [f"w{k}".encode() for k in range(1, 30)]
    place, hashes = phrases.neighbours(sequence, words, "en")
    plain = Counter((int(a), int(b)) for a, b in zip(sequence, sequence[1:]) if a and b)
    assert len(hashes) == sum(plain.values()) and len(set(hashes.tolist())) == len(plain)
    values, counts = np.unique(hashes, return_counts=True)
    left = phrases.linked(sequence, place[np.isin(hashes, values[counts >= 8])])
    frequent = {p: c for p, c in plain.items() if c >= 8}
    assert Counter((a, b) for a, b in zip(left.tolist(), left[1:].tolist()) if a and b) == frequent and 0 < len(frequent) < len(plain)
    assert left[0] == left[-1] == 0 and phrases.linked(sequence, place[:0]).tolist() == [0]
    assert (phrases.unpacked_small(phrases.packed_small(np.array([0, 1, 255, 256, 2**32 - 1]))) == [0, 1, 255, 256, 2**32 - 1]).all()

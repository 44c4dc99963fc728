import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stockroom.llm import packing
from stockroom.llm.queries import op4_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
MINE, THEIRS = packing.WordIds(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
PARTS = ["a", " ", "\n", "é", "́", "Σ", "ΑΣ", "\x1d", "\x85", " ", "don't", "<|endoftext|>", "🧿", "12", ".", "_x"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_ids_as_the_library(text):
    assert np.frombuffer(MINE.encode([text])[0], "<u4").tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def least_bins(lengths, capacity):
    """Fewest bins by search over all assignments."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, rest + [room - lengths[k]])
        place(k + 1, bins + [capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_never_exceeds_the_best_packing(lengths):
    lengths = np.array(lengths)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    at, offset, free = packing.best_fit(lengths, 20)
    assert bound <= least_bins(sorted(lengths.tolist(), reverse=True), 20) <= len(free)
    assert -(-lengths.sum() // 20) <= bound


def checked(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_rounds_reach_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_ROWS", 100)
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 60, 900)] + [100] * 10
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    assert checked(rows, 100) <= packing.lower_bound(np.bincount(lengths, minlength=101), 100) + 1
    assert packing.pack(df.limit(0), 100).count() == 0


def test_many_partitions_that_miss_their_bound(spark, monkeypatch):
    """Pieces of two lengths that only fit together across partitions, and pieces that never do."""
    monkeypatch.setattr(packing, "PACK_ROWS", 20)
    monkeypatch.setattr(packing, "MOST_ROWS", 60)
    rng = np.random.default_rng(8)
    lengths = [int(x) for x in rng.choice([34, 67, 51, 49, 52], 800)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    alone = len(packing.best_fit(np.array(lengths), 100)[2])
    assert checked(rows, 100) <= alone * 1.02


def test_word_store_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    store = packing.WordIds(open(PATH, encoding="utf-8").read())
    texts = [f"common word{i} Naïve\u2003wide {'x' * (i % 50)}q, {'a' if i % 9 else chr(28)}b it's <|endoftext|> 12. " for i in range(300)]
    for i in range(0, 300, 7):
        got = store.encode(texts[i:i + 7])
        assert got == [np.array(THEIRS.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[i:i + 7]]
        assert "common" in store.young and len(store.young) + len(store.old) < 200


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "word " * 9000), (2, "")], "doc_id long, text string")
    rows = packing.pack_documents(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == [
        (0, 0, 0, 4096), (0, 1, 4096, 4096), (0, 2, 8192, 809), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 1)]
    assert checked(rows, 4096) == 3


@pytest.mark.parametrize("rows_at_once", [50, 100_000])
def test_whole_table(spark, sf_dir, monkeypatch, rows_at_once):
    monkeypatch.setattr(packing, "PACK_ROWS", rows_at_once)
    rows = op4_best_fit_packing(spark, sf_dir).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert len(got) == len(rows)
    lengths, want = [], {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(THEIRS.encode(d.text, add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[d.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
    assert got == want
    assert checked(rows, 4096) == packing.lower_bound(np.bincount(lengths, minlength=4097), 4096)


def test_sequences_hold_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    packed = packing.pack_documents(docs, PATH)
    lengths = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    out = packing.sequences(packed, docs, PATH).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in out} == lengths


class Asked:
    """A tokenizer that notes how many words it is given at once."""

    def __init__(self, inner, asked):
        self.inner, self.asked = inner, asked

    def encode_batch_fast(self, texts, **options):
        self.asked.append(sum(len(t.split(" ")) for t in texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_encoding_works_in_small_portions(monkeypatch):
    """The tokenizer never holds many words at once, and a batch of texts is encoded in parts; neither changes the ids."""
    texts = [" ".join(f"wort{n}x{k} Größe{n}{k} слово{n}{k}, {n}-{k}!" for k in range(40)) for n in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    coder = packing.WordIds(open(PATH, encoding="utf-8").read())
    want = [coder.whole([t or ""])[0] for t in texts]
    monkeypatch.setattr(packing, "AT_ONCE", 16)
    monkeypatch.setattr(packing, "TEXT_BYTES", 4000)
    coder, asked = packing.WordIds(open(PATH, encoding="utf-8").read()), []
    coder.tokenizer, coder.plain = Asked(coder.tokenizer, asked), coder.plain and Asked(coder.plain, asked)
    parts = list(packing._parts(batch))
    assert len(parts) > 3 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [ids for part in parts for ids in coder.encode(packing.strings(part.column(1)))] == want
    assert max(asked) <= 16 and len(asked) > 10


def test_words_that_differ_in_marks_are_encoded_once():
    tails = ["", "!!", "$$$", "...", "%", ";", "'", "<|", "_-"]
    text = " ".join(word + tail for word in ("größe", "word", "слово") for tail in tails)
    coder, asked = packing.WordIds(open(PATH, encoding="utf-8").read()), []
    coder.tokenizer, coder.plain = Asked(coder.tokenizer, asked), coder.plain and Asked(coder.plain, asked)
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == THEIRS.encode(text, add_special_tokens=False).ids
    assert sum(asked) <= 3 + len(tails)

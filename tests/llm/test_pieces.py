import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from stockroom.llm import pieces
from stockroom.llm.queries import op1_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
MINE, THEIRS = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "一", "🧿", "▁", "the", "ing", ".", "s", "<s>", "\x00", "́", "wh", " " * 17, "aaaa"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_encodes_as_the_library(text):
    ids = MINE.encode(text, ends=True)
    assert ids == THEIRS.encode(text, add_bos=True, add_eos=True)
    assert MINE.decode(ids) == THEIRS.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=8))
def test_decodes_any_ids_as_the_library(ids):
    assert MINE.decode(ids) == THEIRS.decode(ids)


@pytest.mark.parametrize("count", [1, 2, 14, 15, 16, 17, 31, 33, 500, 5000])
def test_runs_of_spaces_and_very_long_words(count):
    for text in (" " * count, "x" + " " * count + "y", "a" * count, "whwh" * count):
        assert MINE.encode(text) == THEIRS.encode(text)


def test_frames(spark):
    rows = [(1, "some words\nand more", 1), (2, None, 2), (2, "", 3), (None, "x" * 70_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = pieces.encode_documents(df, PATH)
    assert sorted(map(tuple, pieces.decode_documents(encoded, PATH).collect()), key=str) == sorted(
        [(i, t or "") for i, t, _ in rows], key=str)
    digests = pieces.round_trip_digests(df, PATH).collect()
    assert sorted(r.n_tokens for r in digests) == sorted(len(THEIRS.encode(t or "")) + 2 for _, t, _ in rows)
    assert pieces.round_trip_digests(df.limit(0), PATH).count() == 0


def test_whole_table(spark, sf_dir):
    import hashlib
    import struct
    rows = {r.doc_id: r for r in op1_sentencepiece(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = THEIRS.encode(d.text, add_bos=True, add_eos=True)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256(THEIRS.decode(ids).encode()).hexdigest())

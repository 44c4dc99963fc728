import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stockroom.llm import packing
from test_simhash import plain_bits, roots
from test_suffixes import plain


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, clean, single, cut, packed = stages(spark, docs, sf_dir, tmp_path)
    assert clean.columns == single.columns == cut.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id: r for r in clean.collect()}
    assert sum(labels[i] == 0 and i not in kept for i in labels) <= 2
    assert {r.text for r in clean.collect()} <= {r.text for r in first.collect()}
    # Near copies
    bits = {i: plain_bits(r.text, 4) for i, r in kept.items()}
    ids = sorted(bits)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (bits[a] ^ bits[b]).bit_count() <= 4])
    left = {r.doc_id: r for r in single.collect()}
    assert set(left) == set(root.values()) and all(left[i] == kept[i] for i in left)
    # Repeated strings
    want = plain([(i, r.text) for i, r in left.items()], 100)
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == set(left)
    for i, r in after.items():
        gone = want[i, left[i].text][1]
        size = len(left[i].text.encode()) - gone
        assert size - 6 * want[i, left[i].text][2] <= len(r.text.encode()) <= size and r.n_chars == (len(r.text) if gone else left[i].n_chars)
    # Sequences
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}
    rows = packed.collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths
    counts = np.bincount([r.length for r in rows], minlength=4097)
    assert len({r.sequence_id for r in rows}) == packing.lower_bound(counts, 4096)


def test_run_and_edges(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "x", "y", 0), (10 ** 6, None, None, None, None),
                                 (10 ** 6, "w " * 50_000, "en", None, 1), (10 ** 6, "w " * 50_000, "en", None, 1)], docs.schema)
    mixed = docs.limit(50).union(odd)
    out = stages(spark, mixed, sf_dir, tmp_path)
    assert out[-1].count() >= out[3].count() > 0 and out[2].where("doc_id is null").count() == 2
    empty = stages(spark, docs.limit(0), sf_dir, tmp_path / "empty")
    assert [d.count() for d in empty] == [0] * 5

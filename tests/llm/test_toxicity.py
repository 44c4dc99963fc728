import math
import zlib
from collections import Counter

import numpy as np

from stockroom.llm import toxicity
from stockroom.llm.queries import op5_toxicity


def plain(words):
    """Kneser-Ney ratios by dictionaries: words is a list of (word, ordinary count, toxic count)."""
    order, marks = toxicity.ORDER, toxicity.START * (toxicity.ORDER - 1)
    grams = [Counter(), Counter()]
    for word, *counts in words:
        text = marks + word + toxicity.END
        for i in range(order - 1, len(text)):
            for k in (0, 1):
                if counts[k]:
                    grams[k][text[i - order + 1:i + 1]] += counts[k]
    types = set(grams[0]) | set(grams[1])
    tables, now = [], types
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in now))
        now = set(tables[-1])

    def shared(g, k):
        if k == len(tables):
            return 1 / (len(tables[-1]) + 1)
        same = [n for o, n in tables[k].items() if o[:-1] == g[:-1]]
        d = toxicity.SHARED_DISCOUNT
        return max(tables[k][g] - d, 0) / sum(same) + d * len(same) / sum(same) * shared(g[1:], k + 1)

    def class_prob(k, g):
        off = {o: min(n, toxicity.DISCOUNTS[min(n, 3)]) for o, n in grams[k].items() if o[:-1] == g[:-1]}
        total = sum(grams[k][o] for o in off)
        back = sum(off.values()) / total if total else 1.0
        return ((grams[k][g] - off.get(g, 0)) / total if total else 0.0) + back * shared(g[1:], 0)

    return {g: math.log(class_prob(1, g) / class_prob(0, g)) for g in types}


def test_model_by_brute_force():
    words = [("anna", 3, 0), ("ann", 2, 1), ("banner", 0, 2), ("bad", 0, 5), ("a", 7, 1), ("bandana", 1, 0)]
    model = toxicity.learnt([w[0] for w in words], np.array([w[1] for w in words]), np.array([w[2] for w in words]))
    want = plain(words)
    assert sorted(want.values()) == [*map(lambda x: __import__("pytest").approx(x, abs=1e-9), sorted(model[1].tolist()))]
    ratios = toxicity.Ratios(model)
    ratios.learn(["banner"])
    text = toxicity.START * 6 + "banner" + toxicity.END
    assert abs(ratios.words["banner"] - sum(want[text[i - 6:i + 1]] for i in range(6, len(text)))) < 1e-9


def test_held_out_accuracy(spark):
    rows = op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p == t == 1 for p, t in test)
    assert sum(p == t for p, t in test) / len(test) > 0.97
    assert hit / sum(t for _, t in test) > 0.85 and hit / sum(p for p, _ in test) > 0.9


def test_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "some text", "x"), (7, None, None), (7, "", "x"), (900_001, "idiot " * 50_000, "x")],
                                docs.schema.simpleString()[7:-1].replace("bigint", "long"))
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int").union(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic"))
    rows = toxicity.toxicity(docs.union(odd), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(odd, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0

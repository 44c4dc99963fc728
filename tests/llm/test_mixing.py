import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stockroom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is over a source's limit is shared anew until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_ones, left, found = set(names), share * sum(sizes.values()), {}
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if level * weight[s] > most * sizes[s]}
        if not full:
            return found | {s: level * weight[s] for s in open_ones}
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
        open_ones -= full
    return found


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 300])), rng.choice(["hot"] * 6 + ["a", "ä", "z", None, "tiny"]) if i % 90 else f"one{i}") for i in range(n)]
    return rows + [(1000, "x\t y\x0bz z\r\n", "a"), (1001, None, "a"), (None, "a b", "z"), (5, "d " * 70_000, "hot"), (7, "s t", "a"), (7, "s t", "a"), (1002, "", "none")]


@pytest.mark.parametrize("block, chunk, shard", [(512, 50_000, 256), (7, 30, 16), (1, 50_000, 256)])
def test_quotas_to_the_word(spark, monkeypatch, block, chunk, shard):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", shard)
    monkeypatch.setattr(mixing, "SHARDS_TOGETHER", 5)
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    made = mixing.mix(df, block=block)
    got = mixing.taken(made).collect()
    count = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    want = targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((d, count(t), sizes[s]) for d, t, s in rows)
    by_target = defaultdict(int)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for r in got:
        by_target[r.source_size, round(r.target, 6)] += r.taken
    for s, size in sizes.items():  # sources of one size and target are held together
        alike = [x for x in sizes if sizes[x] == size and abs(want[x] - want[s]) < 1e-6]
        assert abs(by_target[size, round(want[s], 6)] - sum(round(want[x]) for x in alike)) <= len(alike) * 0.5
    # The mix itself: the same words, none twice in one round.
    mixed = mixing.mixed(made).groupBy("doc_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()
    totals = Counter()
    for r in got:
        totals[r.doc_id] += r.taken
    assert {r.doc_id: r.n for r in mixed} == {d: n for d, n in totals.items() if n}


def test_reruns_agree_and_shards_follow_the_weights(spark):
    df = spark.createDataFrame([(i, "a b c d " * 50, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    made = mixing.mix(df, block=10)
    first, again = mixing.taken(made).collect(), mixing.taken(mixing.mix(df.repartition(7), block=10)).collect()
    assert sorted(first) == sorted(again)
    counts = made.slots.groupBy("shard").pivot("source_no").count().collect()
    total = made.slots.count()
    quota = {r.source_no: r.slots / total for r in made.sources.collect()}
    shares = [{s: (r[str(s)] or 0) / sum(r[str(x)] or 0 for x in quota) for s in quota} for r in counts[:-1]]
    for s, q in quota.items():
        assert abs(sum(x[s] for x in shares) / len(shares) - q) < 0.03
        assert len({round(x[s], 4) for x in shares}) > 10  # drawn, not dealt


@pytest.mark.parametrize("count", [1, 2, 3, 1000, 4097])
def test_shuffle_is_a_permutation(spark, count):
    rows = spark.range(count).select(F.col("id").alias("i"), F.lit(count).cast("long").alias("n"), F.lit(4).alias("k"))
    got = [r.i for r in mixing.shuffled(rows, "i", "n", "k").collect()]
    assert sorted(got) == list(range(count))
    if count > 100:
        assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < count / 20


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(df)).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, " \t", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.taken(mixing.mix(none)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]

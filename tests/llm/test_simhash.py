import numpy as np
import xxhash

from stockroom.llm import simhash
from stockroom.llm.graph import components
from stockroom.llm.queries import op8_simhash


def plain_bits(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + \
        [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for e in links if e[0] != e[1] for n in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_near_pair_is_connected(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 60)
    bits = {0}
    for b in base.tolist():  # chains, and a dense ball around some of them
        for _ in range(60 if b % 5 == 0 else 4):
            word = b & (2 ** 64 - 1)
            for j in rng.choice(64, rng.integers(0, 6), replace=False):
                word ^= 1 << int(j)
            bits.add(word - 2 ** 64 if word >> 63 else word)
    bits = sorted(bits)
    for most in (0, 3, 4):
        near = [(a, b) for i, a in enumerate(bits) for b in bits[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= most]
        links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(b,) for b in bits], "bits long"), most).collect()]
        assert set(links) <= set(near)
        assert roots(bits, links) == roots(bits, near)


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "y"), (3, "a B c", "z"), (None, "a b C", "z"), (9, "a b c d e f g " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    short = f"{plain_bits('a b c', 4):016x}"
    assert got == sorted([(5, "0" * 16, 3), (3, "0" * 16, 3), (3, short, 3), (None, short, 3),
                          (9, f"{plain_bits(rows[4][1], 4):016x}", 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    bits = {d.doc_id: plain_bits(d.text, 4) for d in docs}
    ids = sorted(bits)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (bits[a] ^ bits[b]).bit_count() <= 4]
    want = {(i, f"{bits[i]:016x}", r) for i, r in roots(ids, links).items()}
    assert {tuple(r) for r in op8_simhash(spark, sf_dir).collect()} == want

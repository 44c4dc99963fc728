"""Near-duplicates by SimHash, joined through the code words of a covering code.

Anchors: the bits of a fingerprint are cut into blocks of seven, in which the Hamming [7,4] code covers every word within
one bit; on the remaining bits the code has the zero word only. Every 64-bit word thus has a nearest anchor, its home.
Two fingerprints at most t bits apart have a word half way between them, so replicating each fingerprint to the homes of all
words within t/2 bits of it brings every such pair to a common anchor, where their bits are compared. Copies per
fingerprint do not depend on the data (at most 1 + 18 + 156 with six blocks and t = 4), and the anchors (16 million
with six blocks) spread them evenly. Equal fingerprints are one node before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import lean, partitions, strings, written
from stockroom.llm.graph import components

BLOCKS = 6
#: The check columns of a Hamming [7,4] code: bit i of a word belongs to the syndrome i + 1.
SYNDROME = np.array([np.bitwise_xor.reduce(np.array([i + 1 for i in range(7) if w >> i & 1], int), initial=0) for w in range(128)])
WORDS = np.flatnonzero(SYNDROME == 0)


def fingerprint(text: str, words_per_shingle: int) -> int:
    """The 64-bit SimHash of a text as a signed number; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first = (ends - size).tolist()
    last = ends[words_per_shingle - 1:].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    ones, count = np.zeros(64, np.int64), 0
    for low in range(0, len(last), 1 << 16):  # bits of a very long text are counted in parts
        part = np.array([digest(line[s:e], 42) for s, e in zip(first[low:low + (1 << 16)], last[low:low + (1 << 16)])], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words_per_shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, bits long) per row. Null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t, words_per_shingle) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], [id_column, "bits"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(lean(run), f"`{id_column}` {kind}, bits long")


def _homes(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of seven bits: the code words (by number) that are home to some word within `radius` bits, and how many bits
    away. Flat arrays with the place and number of each word's entries."""
    number = np.full(128, -1)
    number[WORDS] = np.arange(len(WORDS))
    home = np.array([number[w if s == 0 else w ^ (1 << (s - 1))] for w, s in enumerate(SYNDROME)])
    popcount = np.array([bin(w).count("1") for w in range(128)])
    away = np.full((128, len(WORDS)), 99)
    for w in range(128):
        np.minimum.at(away[w], home, popcount[np.arange(128) ^ w])
    word, code = np.nonzero(away <= radius)
    counts = np.bincount(word, minlength=128)
    return code, away[word, code], np.cumsum(counts) - counts, counts


def anchors_of(bits: np.ndarray, radius: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(index into `bits`, anchor) of every copy."""
    code, cost, place, counts = _homes(radius)
    at, anchor, spent = np.arange(len(bits)), np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
    words = bits.view(np.uint64)
    for block in range(blocks):
        word = (words[at] >> np.uint64(7 * block) & np.uint64(127)).astype(np.int64)
        times = counts[word]
        choice = np.repeat(place[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, anchor, spent = np.repeat(at, times), np.repeat(anchor, times) << 4 | code[choice], np.repeat(spent, times) + cost[choice]
        fits = spent <= radius
        at, anchor, spent = at[fits], anchor[fits], spent[fits]
    return at, anchor


def _joined(bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among many fingerprints at one anchor: each step takes all that one reaches."""
    rest, left, right = bits, [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= max_bits
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                todo += found.tolist()
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (bits[:0], bits[:0])


def near_links(nodes: DataFrame, max_bits: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) links between distinct fingerprints (`bits` long) at most `max_bits` apart.

    Every pair within the distance is connected, directly or over links of its anchor. Copies travel as packed arrays, one
    per task and range of anchors.
    """
    radius = (max_bits + 1) // 2
    ranges = min(16 ** blocks, 4 * partitions(nodes))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy()
            at, anchor = anchors_of(bits, radius, blocks)
            bucket = anchor * ranges >> 4 * blocks
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(ranges + 1))
            at, anchor = at[order], anchor[order]
            packed = [(r, np.concatenate([anchor[s:e], bits[at[s:e]]]).tobytes())
                      for r, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int32()),
                                              pa.array([p[1] for p in packed], pa.binary())], ["range", "copies"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(r, []).append(data)
        for r in list(parts):
            pairs = [np.frombuffer(p, np.int64).reshape(2, -1) for p in parts.pop(r)]
            anchor, bits = np.concatenate(pairs, axis=1)
            order = np.argsort(anchor, kind="stable")
            anchor, bits = anchor[order], bits[order]
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            size = np.diff(np.r_[start, len(anchor)])
            left, right = [], []
            large = size > 32
            for s, n in zip(start[large].tolist(), size[large].tolist()):
                a, b = _joined(bits[s:s + n], max_bits)
                left.append(a)
                right.append(b)
            within = np.repeat(~large, size)
            anchor, bits = anchor[within], bits[within]
            for step in range(1, 32):
                same = np.flatnonzero(anchor[step:] == anchor[:-step])
                if not len(same):
                    break
                near = same[np.bitwise_count((bits[same] ^ bits[same + step]).view(np.uint64)) <= max_bits]
                left.append(bits[near])
                right.append(bits[near + step])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    packed = nodes.select("bits").repartition(partitions(nodes), "bits").mapInArrow(lean(copies), "range int, copies binary")
    return packed.repartition(partitions(nodes), "range").mapInArrow(lean(compare), "a long, b long").distinct()


def _named(marks: DataFrame, max_bits: int) -> DataFrame:
    """(bits, component_id) of every fingerprint of `marks` (doc_id, bits)."""
    nodes = written(marks.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    roots = written(components(near_links(nodes, max_bits)), "roots")
    named = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(named.join(smallest, "root").select("bits", "component_id"), "named")


def keep_one(df: DataFrame, words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of `df` whose doc_id is the smallest of their component, all columns kept.

    Of several rows with that doc_id the ones with the smallest hash of their text stay (rows that repeat both stay together, as one
    document). Rows without doc_id stay: nothing tells which of them is the copy.
    """
    mark = F.xxhash64("text")
    marks = written(fingerprints(df.select("doc_id", F.struct("doc_id", mark.alias("mark")).alias("key"), "text"),
                                 words_per_shingle, "key").select("key.*", "bits"), "fingerprints")
    named = _named(marks, max_bits)
    kept = marks.join(named, "bits").where("doc_id = component_id").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    rows = df.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), mark.alias("mark"))
    return rows.join(kept, ["doc_id", "mark"], "left_semi").union(rows.where("doc_id is null").select("doc_id", "mark", "row")).select("row.*")


def near_duplicates(df: DataFrame, words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable over links of at most
    `max_bits` differing bits.

    Null or empty texts have the fingerprint zero and are linked like any other. Rows with the same or no doc_id stay rows of their
    own; a component of null ids only has a null component_id. An empty table gives no rows.
    """
    marks = written(fingerprints(df.select("doc_id", "text"), words_per_shingle), "fingerprints")
    named = _named(marks, max_bits)
    return marks.join(named, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")

"""Document fingerprints: MinHash signatures of word shingles.

Words and shingles of many texts are hashed at once in numpy; each of the universal hash functions a*x + b (mod 2^64) orders
the shingles of a text anew, and the least value of each, cut to 16 bits, is one component of the fingerprint. Equal texts have equal
fingerprints, and the share of equal components estimates the Jaccard likeness of two texts' shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import lean, partitions, slices, strings, text_bytes, written
from stockroom.llm.graph import components
from stockroom.llm.suffixes import Hashes, mixed

PERMUTATIONS = 128
WORDS = 5
#: Bytes that are hashed at once.
SLICE = 1 << 18
_rng = np.random.default_rng(5_2024)
FACTOR = _rng.integers(0, 2 ** 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
SHIFT = _rng.integers(0, 2 ** 64, PERMUTATIONS, dtype=np.uint64)
WEIGHT = _rng.integers(0, 2 ** 64, 16, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
NO_ID = 1 - 2 ** 63


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, some words at a time; a word longer than two slices has a hash of another kind."""
    out, low = np.zeros(len(start), np.uint64), 0
    while low < len(start):
        base = start[low]
        high = int(np.searchsorted(end, base + 2 * SLICE, "right"))
        if high == low:
            out[low] = xxhash.xxh64_intdigest(data[base:end[low]].tobytes())
            high = low + 1
        else:
            out[low:high] = mixed(Hashes(data[base:end[high - 1]]).of(start[low:high] - base, end[low:high] - base))
        low = high
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several texts, and how many each text has.

    A word is a run of bytes other than ASCII white space, A-Z in lower case. A text of fewer words is one shingle; one without words has none.
    """
    count = len(offsets) - 1
    blank = SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # a text ends the word before it
    first[offsets] = True
    start = np.flatnonzero(~blank & (first[:-1] | np.r_[True, blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & (first[1:] | np.r_[blank[1:], True])) + 1 if len(data) else start
    row = np.searchsorted(offsets, start, "right") - 1
    number = np.bincount(row, minlength=count)
    word = word_hashes(LOWER[data], start, end)
    place = np.arange(len(word)) - np.repeat(np.cumsum(number) - number, number)
    taken = (place <= np.repeat(number, number) - words) | (place == 0)
    at = np.flatnonzero(taken)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = place[at] + k < number[row[at]]
        value += np.where(inside, word[np.minimum(at + k, len(word) - 1)] * WEIGHT[k], 0) if len(word) else 0
    return mixed(value), np.bincount(row[at], minlength=count)


def signatures(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text as a row of 16-bit numbers; all zero without words."""
    out = np.zeros((len(offsets) - 1, PERMUTATIONS), np.uint16)
    for low, high in slices(offsets, SLICE):
        value, number = shingles(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], words)
        some = np.flatnonzero(number)
        if len(some):
            start = (np.cumsum(number) - number)[some]
            for k in range(PERMUTATIONS):
                out[low + some, k] = np.minimum.reduceat(value * FACTOR[k] + SHIFT[k], start) >> np.uint64(16) & np.uint64(0xFFFF)
    return out


def of_texts(texts: list[str], words: int = WORDS) -> np.ndarray:
    raw = [t.encode() for t in texts]
    return signatures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]), words)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by as many characters of the other's start, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + other[:third]


def fingerprints(df: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(s) for s in signatures(data, offsets, words)], pa.string())],
                                             [id_column, "fingerprint"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(lean(run), f"`{id_column}` {kind}, fingerprint string")


def with_next(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text) dealt by ranges of descending doc_id and sorted, each range followed by the first row of the next range (the
    last range by the very first row). Also the number of ranges.

    No id counts as the smallest; rows with one id are ordered by a mark of their text.
    """
    spark = df.sparkSession
    docs = df.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"))
    ranges = partitions(df)
    cuts = docs.select("doc").approxQuantile("doc", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    # Doubles may merge ids beyond 2^53; whole numbers keep equal ids in one range.
    cuts = np.unique(np.array(cuts, np.float64).astype(np.int64)) if cuts else np.zeros(0, np.int64)

    @F.arrow_udf("int")
    def part(doc: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(-cuts[::-1], -doc.to_numpy(zero_copy_only=False), "left"), pa.int32())

    docs = docs.withColumn("part", part("doc"))
    firsts = sorted(docs.groupBy("part").agg(F.max(F.struct("doc", F.negate("mark").alias("order"), "mark")).alias("top")).collect())  # one per range
    rows = [(r["top"]["doc"], r["top"]["mark"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]
    guests = spark.createDataFrame(rows, "doc long, mark long, host int")
    here = F.struct(F.col("part"), F.lit(False).alias("guest"))
    there = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    placed = docs.join(F.broadcast(guests), ["doc", "mark"], "left").select(
        "doc_id", "text", "doc", "mark", F.explode(F.when(F.col("host").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    count = len(cuts) + 1
    return placed.repartitionById(count, F.col("at.part")).sortWithinPartitions(
        "at.part", "at.guest", F.desc("doc"), F.negate("mark").desc()).select("doc_id", "text", "at.guest"), count


def edited_likeness(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last third replaced by the start of the next document's text, in descending doc_id; the first follows the last. Null
    text is empty; two texts without words are alike. Rows without doc_id come last, and repeated rows follow each other. An empty
    table gives no rows.
    """
    if df.isEmpty():
        rows = df.select("doc_id", "text", F.lit(False).alias("guest"))
    else:
        rows, _ = with_next(df.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held_text, held_mark, done = None, [], None, False
        for batch in batches:
            texts, guests = strings(batch.column(1)), batch.column(2).to_pylist()
            low = 0
            while low < len(texts) and not done:  # some texts at a time, so that batches of long texts stay small
                high, size = low, 0
                while high < len(texts) and not done and (high == low or size < 1 << 23):
                    size += len(texts[high])
                    done = guests[high]  # the first guest ends the range
                    high += 1
                now = held_text + texts[low:high]
                marks = of_texts(texts[low:high], words)
                marks = np.concatenate([held_mark, marks]) if held_text else marks
                ids = pa.chunked_array([c for c in (held_id, batch.column(0).slice(low, high - low)) if c is not None]).combine_chunks()
                changed = [edited(a, b) for a, b in zip(now, now[1:])]
                marks2 = of_texts(changed, words)
                count = len(changed)
                if count:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(0, count), pa.array(map(len, now[:count]), pa.int64()),
                         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                         pa.array([shown(s) for s in marks[:count]]), pa.array([shown(s) for s in marks2]),
                         pa.array((marks[:count] == marks2).mean(axis=1)), pa.array((marks[:count] == marks[1:]).mean(axis=1))],
                        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                held_id, held_text, held_mark = ids.slice(count), now[count:], marks[count:]
                low = high

    kind = df.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                "near_edited double, near_next double")


def _banded(df: DataFrame, words: int, bands: int) -> DataFrame:
    """(class, keys array<long>, shingles binary) of distinct texts: one key per band of the signature, and the sorted shingle hashes."""
    width = PERMUTATIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            marks, sets = signatures(data, offsets, words), []
            for k in range(batch.num_rows):
                part = data[offsets[k]:offsets[k + 1]]
                sets.append(np.unique(shingles(part, np.array([0, len(part)]), words)[0]).tobytes())
            keys = [[xxhash.xxh64_intdigest(m[b * width:(b + 1) * width].tobytes(), b) >> 1 for b in range(bands)] for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                                             ["class", "keys", "shingles"])

    return df.mapInArrow(lean(run), "class long, keys array<long>, shingles binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingles have a Jaccard likeness of at least `least`, computed in full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("class").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(lean(run), "a long, b long")


def near_duplicates(df: DataFrame, least: float = 0.8, words: int = WORDS, bands: int = 32) -> DataFrame:
    """(doc_id, component_id): documents connected by word shingles alike to `least` or more; the smallest doc_id reachable.

    Equal texts are one class. Signatures are cut into bands; classes that share a band's key meet in Spark and are verified by the Jaccard
    likeness of their whole shingle sets. With 32 bands of four components a pair of likeness 0.8 is missed once in ten million. In
    each bucket one class is compared with all others; those that are alike are then compared with those still open, and so on
    until none is open, so a bucket of copies costs about as many comparisons as it has members, not their square.
    Null text is empty; texts without words are alike. Rows without doc_id count in their components. An empty table gives no rows.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("class", F.xxhash64("text"))
    classes = rows.groupBy("class").agg(F.max("text").alias("text"))
    sets = written(_banded(classes.select("class", "text"), words, bands), "shingles")
    members = sets.select(F.explode("keys").alias("key"), "class")
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("a")).where("n > 1")
    pending = written(members.join(shared, "key").where("class != a").select("key", F.col("class").alias("b")), "open")
    front = written(shared.select("key", "a"), "front")
    links = None
    while not pending.isEmpty():
        met = front.join(pending, "key")
        found = written(_alike(met.select("a", "b").distinct(), sets, least), "links")
        links = found if links is None else links.union(found)
        joined = written(met.join(found, ["a", "b"]).select("key", F.col("b").alias("a")).distinct(), "front")
        rest = pending.join(joined, (pending["key"] == joined["key"]) & (pending["b"] == joined["a"]), "left_anti")
        # A bucket whose front found nobody goes on from its smallest open class.
        fresh = rest.join(joined.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("b").alias("a"))
        front = written(joined.union(fresh), "front")
        pending = written(rest.join(fresh, (rest["key"] == fresh["key"]) & (rest["b"] == fresh["a"]), "left_anti"), "open")
    if links is None:
        links = df.sparkSession.createDataFrame([], "a long, b long")
    roots = components(links).withColumnRenamed("node", "class")
    named = rows.select("doc_id", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "component_id")

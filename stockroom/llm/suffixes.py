"""Removing repeated strings of a fixed number of bytes, by a distributed sort of suffixes.

Every byte starts a suffix; two suffixes repeat each other if their first `span` bytes are equal, and then the later one
(larger doc_id, or later in the same document) is covered. Suffixes are range-partitioned by their leading bytes at sampled
splitters, each range is sorted by multikey quicksort, and a suffix is a repeat if it equals its predecessor; the first of a
range is compared with the last of the range before.

Sorting all suffixes would move a hundred times the input, so the sort is done in two steps, both exact:

1. Within its first `span` bytes each suffix has one anchor: the smallest of its 32-byte grams by hash, the leftmost of equals.
   Neighbouring suffixes share anchors, so a document is a chain of runs (about one in 35 bytes). Runs are sorted by the
   leading bytes and hash of their anchor gram, then by a hash of all bytes their suffixes look at. A run that equals its predecessor
   is covered whole. A gram with one kind of run only has nothing else to offer.
2. First runs of grams that come with several kinds of runs are opened: all their suffixes are sorted, by their leading eight
   bytes and a hash of the first `span` bytes.

Equal suffixes have equal anchors at equal places, so no repeat is missed; hashes have 64 bits beside the leading bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import lean, partitions, slices, text_bytes, written

GRAM = 32
#: Bytes that are hashed at once.
SLICE = 1 << 18
PLACE = np.uint64(2 * SLICE - 1)
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
LETTER = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
NO_ID = 2 ** 63 - 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < count:
        size = max(count, 2 * SLICE + 1)
        both = []
        for base in (BASE, pow(BASE, -1, 2 ** 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Hashes:
    """Hashes of any stretch of some bytes in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        """Of every stretch of `size` bytes."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size])


def runs_of(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """The runs of suffixes with a common anchor: (row, first start in the row, number, key, content hash)."""
    size, grams = len(data), span - GRAM + 1
    if size < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    hashes = Hashes(data)
    gram = hashes.all(GRAM)
    least = gram & ~PLACE | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[:size - span + 1], least[grams - width:grams - width + size - span + 1])
    anchor = (least & PLACE).astype(np.int64)
    # Suffixes with `span` bytes left in their row.
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    whole = np.arange(len(anchor)) + span <= offsets[row + 1]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new & whole)
    # Only the end of a row cuts whole suffixes off, so a run's whole suffixes are its first ones.
    bounds = np.r_[np.flatnonzero(new), len(anchor)]
    last = np.minimum(bounds[np.searchsorted(bounds, first, "right")], offsets[row[first] + 1] - span + 1)
    count, at = last - first, anchor[first]
    content = hashes.of(first, last - 1 + span) + mixed(((at - first) * 128 + count).astype(np.uint64))
    lead = data[at].astype(np.uint64) << np.uint64(16) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2]
    key = lead << np.uint64(40) | gram[at] >> np.uint64(24)
    return row[first], first - offsets[row[first]], count, key.view(np.int64), mixed(content).view(np.int64)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several words: sorted by the first word, then only runs of ties by the next one."""
    order = np.argsort(words[0])
    tied = None
    for before, word in zip(words, words[1:]):
        sorted_before = before[order]
        same = np.r_[False, sorted_before[1:] == sorted_before[:-1]]
        tied = same if tied is None else tied & same
        inside = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not len(inside):
            break
        group, rows = np.cumsum(~tied)[inside], order[inside]
        order[inside] = rows[np.lexsort((word[rows], group))]
    return order


def packed_place(mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row's mark (25 bits), a start (31 bits) and a number of suffixes (7 bits) in one word, in this order."""
    return mark << 38 | start << 7 | count


RECORD = "key long, content long, doc long, place long"
FOUND = "kind int, range int, doc long, place long, key long, content long, several boolean"
REPEAT, OPEN, FIRST, LAST = range(4)


def neighbours(records: DataFrame, openers: bool) -> DataFrame:
    """Sort records by ranges and report repeats, and with `openers` the first runs of grams with several kinds of runs.

    (kind, doc, place): REPEAT or OPEN. What depends on a range's neighbours is settled from two records of each range.
    """
    spark = records.sparkSession

    def sort_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        del rows
        words = [table.column(i).to_numpy() for i in range(4)]
        del table
        order = multikey_order(words)
        key, content, doc, place = (w[order] for w in words)
        del words, order
        # A table row that is there twice is one document.
        other = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]
        key, content, doc, place = key[other], content[other], doc[other], place[other]
        same_key = np.r_[False, key[1:] == key[:-1]]
        repeat = same_key & np.r_[False, content[1:] == content[:-1]]
        kind = np.where(repeat, REPEAT, -1)
        if openers:
            # A kind of run starts where no repeat is; a gram has several if a start shares the key of the start before or after.
            start = np.flatnonzero(~repeat)
            shared = np.r_[False, key[start][1:] == key[start][:-1]]
            kind[start[shared | np.r_[shared[1:], False]]] = OPEN
        where = TaskContext.get().partitionId()

        def out(at: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
            # Only what is compared with other ranges needs its hashes on disk.
            hashes = [pa.array(w[at]) if kinds[0] >= FIRST else pa.nulls(len(at), pa.int64()) for w in (key, content)]
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(np.full(len(at), where), pa.int32()), pa.array(doc[at]), pa.array(place[at]),
                 *hashes, pa.array(kind[at] == OPEN)],
                ["kind", "range", "doc", "place", "key", "content", "several"])

        # The first record of the range and the first record of its last kind of run, whatever else is said of them.
        ends = np.array([0, np.flatnonzero(~repeat)[-1]])
        yield out(ends, np.array([FIRST, LAST]))
        kind[ends] = -1
        told = np.flatnonzero(kind >= 0)
        for low in range(0, len(told), 50_000):
            part = told[low:low + 50_000]
            yield out(part, kind[part])

    found = written(records.repartitionByRange(partitions(records), "key", "content", "doc", "place").mapInArrow(lean(sort_range), FOUND), "sorted")
    ends = sorted(found.where(F.col("kind") >= FIRST).collect(), key=lambda r: (r["range"], r["kind"]))  # two per range
    kinds_of: dict[int, set[int]] = {}
    for r in ends:
        kinds_of.setdefault(r["key"], set()).add(r["content"])
    # A kind that goes on in later ranges may meet the gram's other kinds only there, away from their ends.
    mixed_keys = {r["key"] for r in ends if r["several"]} | {k for k, kinds in kinds_of.items() if len(kinds) > 1}
    settled, before = [], None
    for first, last in zip(ends[::2], ends[1::2]):
        for r in [first] + [last] * (last["place"] != first["place"] or last["doc"] != first["doc"] or last["content"] != first["content"]):
            equal = r is first and before is not None and (before["key"], before["content"]) == (r["key"], r["content"])
            if equal and (before["doc"], before["place"]) != (r["doc"], r["place"]):
                settled.append((REPEAT, r["doc"], r["place"]))
            elif openers and not equal:
                settled.append((OPEN if r["key"] in mixed_keys else LAST, r["doc"], r["place"]))
        before = last
    told = found.where(F.col("kind") < FIRST).select("kind", "doc", "place")
    return told.union(spark.createDataFrame(settled, "kind int, doc long, place long").where(F.col("kind") < FIRST))


def stretches(data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Rows together or, of a very long row, parts that overlap by the suffixes' length: (first row, end, bytes, offsets, start in the row)."""
    for low, high in slices(offsets, SLICE):
        part = data[offsets[low]:offsets[high]]
        if len(part) <= 2 * SLICE:
            yield low, high, part, offsets[low:high + 1] - offsets[low], 0
        else:
            for at in range(0, len(part), SLICE):
                some = part[at:at + SLICE + span - 1]
                yield low, high, some, np.array([0, len(some)]), at


def keyed(df: DataFrame) -> DataFrame:
    """(row, doc, mark, text): a document is known by its id and a mark of its text, so ids may repeat; no id counts as the largest."""
    return df.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                     F.xxhash64("text").bitwiseAND(F.lit((1 << 25) - 1)).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def covered(docs: DataFrame, span: int) -> DataFrame:
    """(doc, mark, places array<long>): the repeated suffixes of each document of `keyed` that has any."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(2))
            for low, _, some, bounds, base in stretches(data, offsets, span):
                row, first, count, key, content = runs_of(some, bounds, span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(content), pa.array(doc[low + row]),
                     pa.array(packed_place(mark[low + row], first + base, count))], ["key", "content", "doc", "place"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(2))
            lists = batch.column(3)
            places, edges = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for low, high, some, bounds, base in stretches(data, offsets, span):
                mine = places[edges[low]:edges[high]]
                row = np.repeat(np.arange(high - low), np.diff(edges[low:high + 1]))
                start, count = mine >> 7 & (1 << 31) - 1, mine & 127
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, start = np.repeat(row, count), np.repeat(start, count) + step
                if base or len(some) < offsets[high] - offsets[low]:  # a part of a long row has its own starts only
                    inside = (start >= base) & (start < base + SLICE) & (start - base + span <= len(some))
                    row, start = row[inside], start[inside]
                at = bounds[row] + start - base
                if not len(at):
                    continue
                content = mixed(Hashes(some).of(at, at + span)).view(np.int64)
                lead = np.zeros(len(at), np.uint64)
                for k in range(8):
                    lead = lead << np.uint64(8) | some[at + k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead.view(np.int64)), pa.array(content), pa.array(doc[low + row]),
                     pa.array(packed_place(mark[low + row], start, 1))], ["key", "content", "doc", "place"])

    mark = F.shiftright("place", 38).alias("mark")
    runs_found = neighbours(docs.select("doc", "mark", "text").mapInArrow(lean(runs), RECORD), openers=True)
    opened = runs_found.where(F.col("kind") == OPEN).groupBy("doc", mark).agg(F.collect_list("place").alias("places"))
    single = docs.select("doc", "mark", "text").join(opened, ["doc", "mark"]).select("doc", "mark", "text", "places")
    suffixes_found = neighbours(single.mapInArrow(lean(suffixes), RECORD), openers=False)
    repeats = runs_found.where(F.col("kind") == REPEAT).union(suffixes_found.where(F.col("kind") == REPEAT))
    return repeats.groupBy("doc", mark).agg(F.collect_set("place").alias("places"))


def joined_spans(places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches of bytes under the suffixes: starts and ends."""
    if not len(places):
        return places, places
    places = np.sort(places & (1 << 38) - 1)
    start, end = places >> 7, np.maximum.accumulate((places >> 7) + (places & 127) - 1 + span)
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[new[1:], True]]


def remove_repeats(df: DataFrame, span: int = 100, whole_characters: bool = False) -> DataFrame:
    """(row, kept, n_bytes, n_removed, spans, kept_sha256): each row of `df` as a struct, with its text's remaining bytes, or
    with `whole_characters` the text of them without those that make no character.

    `spans` are the maximal removed stretches, [start, end) in bytes of the input. Null text is empty and stays whole. A row
    without doc_id comes after all others; rows with one doc_id are told apart by their text (in no defined order); rows that
    repeat both are one document and get the same result. An empty table gives no rows. `df` is read three times.
    """
    docs = keyed(df)
    joined = docs.join(covered(docs, span), ["doc", "mark"], "left").select("row", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            places, edges = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            kept, removed, spans, digest = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                starts, ends = joined_spans(places[edges[i]:edges[i + 1]], span)
                parts = [text[a:b].tobytes() for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])]
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if whole_characters else left)
                removed.append(int((ends - starts).sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string() if whole_characters else pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digest)],
                ["row", "kept", "n_bytes", "n_removed", "spans", "kept_sha256"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(lean(cut), f"row {row}, kept {'string' if whole_characters else 'binary'}, n_bytes long, n_removed long, "
                                  "spans array<struct<start:long,end:long>>, kept_sha256 string")


def repeat_digests(df: DataFrame, span: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return remove_repeats(df.select("doc_id", "text"), span).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def cleaned(df: DataFrame, span: int = 100) -> DataFrame:
    """`df` with its repeats cut from `text` and, if there is such a column, `n_chars` counted anew.

    All rows stay, also those of which nothing is left. Bytes of a character that was cut through go with it.
    """
    done = remove_repeats(df, span, whole_characters=True)
    whole, text = F.col("n_removed") == 0, F.col("kept")
    columns = {name: F.col("row")[name] for name in df.columns}
    columns["text"] = F.when(whole, F.col("row.text")).otherwise(text)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text).cast(df.schema["n_chars"].dataType))
    return done.select(*(value.alias(name) for name, value in columns.items()))

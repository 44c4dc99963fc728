"""Phrases that stand together more often than their parts would by chance, counted with bidirectional FM-indexes.

Texts become shards: the words of one language as numbers, with a mark wherever a phrase may not go on. Neighbouring words are counted by
hash over all shards first: where two words stand together whose hash comes up too rarely, no frequent phrase goes across, so the shard is
cut there, and words that are left alone drop out. Hashes that meet only keep more than is needed. What remains of a shard is indexed by the
Burrows-Wheeler transform of its words and of their reverse, sorted as deep as a phrase can be long. An interval of the one and one of the
other stand for a phrase; the symbols before (or after) the interval's rows are its extensions to the left (or right), with their
counts, and give the intervals of the longer phrases. The counts of a length are summed over all shards, and only phrases that are
frequent over all shards go back to theirs to be extended. A longer phrase needs both its parts to be frequent, so nothing
is lost, and no shard sends what cannot count.

A language with any part of the rows has as many shards as it needs; a shard holds a bounded number of words, so no task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stockroom import session
from stockroom.llm.common import lean
from stockroom.operators.keyed import first_per_key
from stockroom.operators.numbering import numbered

#: Words of a shard, about.
SHARD_WORDS = 2_000_000
#: Bytes of text that are split at once.
SPLIT_BYTES = 4 << 20
NODE_ROWS = 50_000
#: Rows of an index whose extensions are looked up at once.
EXTENDED_ROWS = 1 << 18
#: Hashes of neighbours are summed in ranges: so many at least, and no more words to a range than these, about.
LEAST_RANGES = 32
RANGE_WORDS = 8_000_000
MAX_BROADCAST_BYTES = 32 << 20
#: Upper case to lower case, tab to space, and a byte that no text holds for every end of a piece.
END = 0xFF
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else END if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))

#: One row per shard with its words as numbers and what they spell, and one per word of it.
SHARDS = "shard long, is_node boolean, lang string, sequence binary, spelling binary, word string, size long"
#: The hashes of the neighbours in a shard and how often each comes up, per range of hashes; those that are frequent over all shards.
NEIGHBOURS = "shard long, part long, hashes binary, counts binary"
FREQUENT = "shard long, hashes binary"
#: One row per shard with what is left of its words, and one per word that is left.
CUT = "shard long, is_node boolean, lang string, sequence binary, number int, word string"
#: One row per shard with both transforms and the ids of its words, and one per phrase of it. A phrase is its words' ids, four bytes each.
PHRASES = "shard long, is_node boolean, before binary, after binary, ids binary, phrase binary, size long"
KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


#: Packed harder than elsewhere: these tables are read once or twice.
written = partial(session.written, compression="zstd")


def _rows(schema: str, count: int, **columns) -> pa.RecordBatch:
    """A batch of `schema`; a column is an array, a list, or one value for all rows, and null if it is left out."""
    arrays, names = [], []
    for name, kind in (field.split() for field in schema.split(", ")):
        value = columns.get(name)
        if not isinstance(value, pa.Array):
            alike = not isinstance(value, (list, np.ndarray))
            value = pa.nulls(count, KINDS[kind]) if value is None else pa.array([value] * count if alike else value, KINDS[kind])
        arrays.append(value)
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed_small(values: np.ndarray) -> bytes:
    """Numbers that are mostly small: first bytes together, then second ones, and so on."""
    return packed(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unpacked_small(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Shard:
    """Words of one language as numbers from 1, with 0 at the ends of pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, data: bytes) -> None:
        found = data.translate(BYTES).replace(b"\xff", b" \xff ").split()
        coded = pa.array(found, pa.binary()).dictionary_encode()
        number = self.number
        codes = [0 if w == b"\xff" else number.setdefault(w, len(number) + 1) for w in coded.dictionary.to_pylist()]
        self.parts += [np.array(codes, np.int32)[coded.indices.to_numpy()], np.zeros(1, np.int32)]
        self.tokens += len(found)

    def rows(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        sequence = np.concatenate([np.zeros(1, np.int32), *self.parts])
        spelling = packed(np.frombuffer(b"\n".join(self.number), np.uint8))
        yield _rows(SHARDS, 1, shard=shard, is_node=False, lang=lang, sequence=packed(sequence), spelling=spelling)
        count = np.bincount(sequence, minlength=len(self.number) + 1)[1:]
        words = pa.array(list(self.number), pa.binary()).cast(pa.string())
        order = np.argsort(np.array(list(self.number), object)) if self.number else np.zeros(0, np.int64)
        for at in range(0, len(order), NODE_ROWS):
            part = order[at:at + NODE_ROWS]
            yield _rows(SHARDS, len(part), shard=shard, is_node=True, lang=lang, word=words.take(pa.array(part)), size=count[part])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) to shards."""
    base, made, open_shards = TaskContext.get().partitionId() << 32, 0, {}
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            for part in _cuts(data):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= SPLIT_BYTES:
                    made = yield from _fill(open_shards, held, base, made)
                    held, size = {}, 0
        made = yield from _fill(open_shards, held, base, made)
    for lang, shard in open_shards.items():
        yield from shard.rows(base + made, lang)
        made += 1


def _cuts(data: bytes) -> Iterator[bytes]:
    """A text, in parts that end where a piece ends if it is long."""
    at = 0
    while len(data) - at > SPLIT_BYTES and (end := PIECE_END.search(data, at + SPLIT_BYTES)):
        yield data[at:end.end()]
        at = end.end()
    yield data[at:]


def _fill(open_shards: dict, held: dict, base: int, made: int) -> Iterator[pa.RecordBatch]:
    for lang, texts in held.items():
        shard = open_shards.setdefault(lang, Shard())
        shard.add(b"\xff".join(texts))
        if shard.tokens >= SHARD_WORDS:
            yield from open_shards.pop(lang).rows(base + made, lang)
            made += 1
    return made


def spelling_of(data: bytes) -> list[bytes]:
    """The words of a shard, in order of their numbers from 1."""
    text = unpacked(data, np.uint8).tobytes()
    return text.split(b"\n") if text else []


def neighbours(sequence: np.ndarray, words: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """The places whose word has a word behind it in the same piece, and a hash of both that is the same in all shards of the language."""
    seed = zlib.crc32(lang.encode())
    word = np.fromiter((0, *(zlib.crc32(w, seed) for w in words)), np.uint64, len(words) + 1)
    place = np.flatnonzero((sequence[:-1] != 0) & (sequence[1:] != 0))
    both = word[sequence[place]] * np.uint64(0x9E3779B97F4A7C15) + word[sequence[place + 1]]
    return place, (both * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


def _neighbours(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards to the counts of their neighbours."""
        borders = np.array([-(-(k << 32) // ranges) for k in range(ranges + 1)], np.uint64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                _, found = neighbours(unpacked(shard["sequence"], np.int32), spelling_of(shard["spelling"]), shard["lang"])
                hashes, counts = np.unique(found, return_counts=True)
                edges = np.searchsorted(hashes, borders)
                parts = np.flatnonzero(np.diff(edges))
                slices = [slice(edges[k], edges[k + 1]) for k in parts]
                yield _rows(NEIGHBOURS, len(parts), shard=shard["shard"], part=parts, counts=[packed_small(counts[at]) for at in slices],
                            hashes=[packed_small(np.diff(hashes[at], prepend=np.uint32(0))) for at in slices])
    return run


def _frequent(least: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one range, the hashes of each shard that come up `least` times over all shards."""
        held = [np.cumsum(unpacked_small(h), dtype=np.uint32) for h in rows["hashes"].to_pylist()]
        every = np.concatenate(held)
        order = np.argsort(every, kind="stable")
        every = every[order]
        head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total = np.add.reduceat(np.concatenate([unpacked_small(c) for c in rows["counts"].to_pylist()])[order], head, dtype=np.int64)
        frequent = every[head[total >= least]]
        kept = [h[np.isin(h, frequent, assume_unique=True)] for h in held]
        some = [k for k, hashes in enumerate(kept) if len(hashes)]
        return pa.table({"shard": rows["shard"].combine_chunks().take(pa.array(some, pa.int64())),
                         "hashes": pa.array([packed(kept[k]) for k in some], pa.binary())})
    return run


def linked(sequence: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The words that are linked to the one before or behind them, with an end wherever there is no link. `place`: words linked to the next."""
    link = np.zeros(len(sequence), bool)
    link[place] = True
    kept = np.flatnonzero(link | np.concatenate([[False], link[:-1]]))
    width = 2 - link[kept]
    result = np.zeros(1 + int(width.sum()), np.int32)
    result[1 + np.cumsum(width) - width] = sequence[kept]
    return result


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards and their frequent hashes to what is left of the shards."""
    for head, nodes in _by_shard(batches):
        if not nodes.num_rows:
            continue
        frequent = np.concatenate([unpacked(h, np.uint32) for h in nodes["hashes"].to_pylist()])
        words, sequence = spelling_of(head["spelling"]), unpacked(head["sequence"], np.int32)
        place, found = neighbours(sequence, words, head["lang"])
        left = linked(sequence, place[np.isin(found, frequent)])
        yield _rows(CUT, 1, shard=head["shard"], is_node=False, lang=head["lang"], sequence=packed(left))
        numbers = np.flatnonzero(np.bincount(left)[1:])
        for at in range(0, len(numbers), NODE_ROWS):
            part = numbers[at:at + NODE_ROWS]
            spelled_out = pa.array([words[k] for k in part], pa.binary()).cast(pa.string())
            yield _rows(CUT, len(part), shard=head["shard"], is_node=True, lang=head["lang"], number=part + 1, word=spelled_out)


def _sorted_rows(sequence: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """Places in order of the `depth` symbols that start there (round the end); equal ones by place."""
    bits = max(1, int(symbols).bit_length())
    together = max(1, 62 // bits)
    order = None
    for low in reversed(range(0, depth, together)):
        key = np.zeros(len(sequence), np.int64)
        for k in range(low, min(depth, low + together)):
            key <<= bits
            key |= np.roll(sequence, -k)
        if order is None:
            order = np.argsort(key, kind="stable").astype(np.int32)
        else:
            key = key[order]
            order = order[np.argsort(key, kind="stable")]
    return order


def transform(sequence: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """The symbol before each place, in order of what stands there."""
    return sequence[_sorted_rows(sequence, depth, symbols) - 1]


def build(sequence: np.ndarray, numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Both transforms of a shard; only the words `numbers` stay, as 1, 2, ... in that order, and runs of ends become one."""
    renamed = np.zeros(int(max(sequence.max(initial=0), numbers.max(initial=0))) + 1, np.int32)
    renamed[numbers] = np.arange(1, len(numbers) + 1)
    kept = renamed[sequence]
    del sequence
    kept = kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])] if len(kept) else kept
    kind = np.uint16 if len(numbers) < 1 << 16 else np.uint32
    return tuple(transform(s, depth, len(numbers)).astype(kind) for s in (kept, kept[::-1]))


def steps(symbols_before: np.ndarray) -> np.ndarray:
    """Where the row of each symbol goes when it is put in front (the LF mapping)."""
    order = np.argsort(symbols_before, kind="stable")
    lf = np.empty(len(order), np.int32)
    lf[order] = np.arange(len(order), dtype=np.int32)
    return lf


def extended(before: np.ndarray, lf: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray):
    """All extensions of the intervals [start, start + size) by the symbols before them: (which interval, symbol, start, other, size).

    `other` are the starts of the same phrases in the other index: there an extension lies behind those by smaller symbols.
    """
    which = np.repeat(np.arange(len(size)), size)
    offset = np.cumsum(size) - size
    place = np.arange(len(which)) - offset[which] + start[which]
    symbol = before[place].astype(np.int64)
    order = np.argsort(which << 32 | symbol, kind="stable")
    key_w, key_s = which[order], symbol[order]
    head = np.flatnonzero(np.concatenate([[True], (key_w[1:] != key_w[:-1]) | (key_s[1:] != key_s[:-1])])) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(order)))
    owner, real = key_w[head], key_s[head] != 0
    return owner[real], key_s[head][real], lf[place[order[head]]][real], (other[owner] + head - offset[owner])[real], count[real]


def _covered(rows: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows lie in one of the intervals; intervals of one length do not overlap."""
    edge = np.zeros(rows + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def portions(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of intervals with about `limit` rows together; a longer one stands alone."""
    end, low = np.cumsum(size), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(end, end[low] - size[low] + limit, "right")))
        yield slice(low, high)
        low = high


class Index:
    """Both transforms of a shard. Phrases of one length are a matrix of symbols, their counts, and their intervals' starts in both."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.symbols, self.lf = (before, after), {}

    def words(self):
        """All words: the interval of one starts behind those of smaller symbols, the same in both indexes; 0 comes first of all."""
        count = np.bincount(self.symbols[0])
        start = np.cumsum(count) - count
        symbol = 1 + np.flatnonzero(count[1:])
        return tuple(a.astype(np.int32) for a in (symbol[:, None], count[symbol], start[symbol], start[symbol]))

    def longer(self, phrase: np.ndarray, size: np.ndarray, f: np.ndarray, r: np.ndarray):
        """Extend every phrase by one word, odd results to the right and even ones to the left; a result must also end (or begin) with one
        of the given phrases."""
        side = (phrase.shape[1] + 1) % 2
        if side not in self.lf:
            self.lf[side] = steps(self.symbols[side])
        start, other = (r, f) if side else (f, r)
        within, found = _covered(len(self.symbols[side]), start, size), []
        for some in portions(size, EXTENDED_ROWS):
            owner, symbol, start2, other2, count = extended(self.symbols[side], self.lf[side], start[some], other[some], size[some])
            known = within[start2]
            owner, symbol = phrase[some][owner[known]], symbol[known, None].astype(np.int32)
            joined = np.concatenate([owner, symbol] if side else [symbol, owner], axis=1)
            found.append((joined, *(a[known].astype(np.int32) for a in ((count, other2, start2) if side else (count, start2, other2)))))
        if not found:
            nothing = np.zeros(0, np.int32)
            return np.zeros((0, phrase.shape[1] + 1), np.int32), nothing, nothing, nothing
        return tuple(np.concatenate(column) for column in zip(*found))


def spelled(phrase: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Phrases of symbols as the ids of their words, four bytes each."""
    return np.ascontiguousarray(ids[phrase - 1].astype(">u4")).view(f"S{4 * phrase.shape[1]}").ravel()


def _nodes(shard: int, phrase: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = 4 * phrase.shape[1]
    for at in range(0, len(size), NODE_ROWS):
        data = ids[phrase[at:at + NODE_ROWS] - 1].astype(">u4").tobytes()
        count = len(data) // width
        names = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.arange(0, len(data) + 1, width, dtype=np.int32)), pa.py_buffer(data)])
        yield _rows(PHRASES, count, shard=shard, is_node=True, phrase=names, size=size[at:at + NODE_ROWS])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table]]:
    """The index row and the nodes of each shard, from rows sorted by shard with the index row first."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        shard = table["shard"].to_numpy()
        borders = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), table.num_rows]
        for low, high in zip(borders, borders[1:]):
            part = table.slice(low, high - low)
            if held and part.num_rows and held[-1]["shard"][0] != part["shard"][0]:
                yield _parted(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield _parted(held)


def _parted(held: list[pa.Table]) -> tuple[dict, pa.Table]:
    table = pa.concat_tables(held)
    return table.slice(0, 1).to_pylist()[0], table.slice(1).combine_chunks()


def _indexer(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences and the ids of frequent words to indexes and pairs."""
        for head, nodes in _by_shard(batches):
            if not nodes.num_rows:
                continue
            ids, numbers = nodes["id"].to_numpy(), nodes["number"].to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            before, after = build(unpacked(head["sequence"], np.int32), numbers[order], depth - 1)
            yield _rows(PHRASES, 1, shard=head["shard"], is_node=False, before=packed(before), after=packed(after), ids=packed(ids.astype(np.int64)))
            index = Index(before, after)
            del before, after, nodes, numbers, order
            pairs, size, *_ = index.longer(*index.words())
            del index
            yield from _nodes(head["shard"], pairs, size, ids)
            del head, pairs, size, ids
    return run


def _extender(lengths: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Indexes and their frequent phrases of up to `lengths[0] - 1` words to phrases of each of `lengths`."""
        for head, nodes in _by_shard(batches):
            if not nodes.num_rows:
                continue
            ids = unpacked(head["ids"], np.int64)
            kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
            index = Index(unpacked(head["before"], kind), unpacked(head["after"], kind))
            frequent: dict[int, list[bytes]] = {}
            for phrase in nodes["phrase"].to_pylist():
                frequent.setdefault(len(phrase) // 4, []).append(phrase)
            held = index.words()
            for length in range(2, lengths[-1] + 1):
                held = index.longer(*held)
                if length in lengths:
                    yield from _nodes(head["shard"], held[0], held[1], ids)
                else:
                    kept = np.isin(spelled(held[0], ids), np.array(frequent.get(length, []), f"S{4 * length}"))
                    held = tuple(column[kept] for column in held)
    return run


def _to_join(frequent: DataFrame, width: int) -> DataFrame:
    """Ready to be joined: broadcast if its rows, of about `width` bytes, are few; met by shuffle otherwise."""
    return F.broadcast(frequent) if frequent.count() * width <= MAX_BROADCAST_BYTES else frequent


def word_id(id: Column) -> Column:
    """The four bytes that stand for a word."""
    return F.unhex(F.lpad(F.hex(id), 8, "0"))


def _left(shards: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """What is left of the shards where neighbours are kept whose hash comes up `least` times or more."""
    heads = shards.where("not is_node").select("shard", "is_node", "lang", "sequence", "spelling")
    ranges = max(LEAST_RANGES, (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS)
    counted = heads.mapInArrow(lean(_neighbours(ranges)), NEIGHBOURS)
    frequent = written(counted.groupBy("part").applyInArrow(_frequent(least), FREQUENT), "neighbours")
    none = F.lit(None)
    dealt = heads.withColumn("hashes", none.cast("binary")).union(frequent.select(
        "shard", F.lit(True), none.cast("string"), none.cast("binary"), none.cast("binary"), "hashes"))
    return written(dealt.repartition("shard").sortWithinPartitions("shard", "is_node").mapInArrow(lean(_cutter), CUT), "left")


def frequent_phrases(df: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase, total): all phrases of 1 to `longest` words that come up `least` times or more in their language, overlaps included, as
    the ids of their words; (id, lang, word) of these words; and (lang, n): all words of each language.

    `df`: lang, text. Null text is empty, a null language is `und`. Repeated rows count each time.
    """
    texts = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shards = written(texts.mapInArrow(lean(_split), SHARDS), "shards")
    nodes = shards.where("is_node")
    totals = written(nodes.groupBy("lang").agg(F.sum("size").alias("n")), "totals")
    words = nodes.groupBy("lang", "word").agg(F.sum("size").alias("total")).where(F.col("total") >= least)
    words = written(numbered(words, ["lang", "word"], "id"), "words")
    found = [words.select(word_id(F.col("id")).alias("phrase"), "total")]
    left = _left(shards, totals, least)
    kept = left.where("is_node").join(_to_join(words.select("lang", "word", "id"), 100), ["lang", "word"]).select("shard", "is_node", "number", "id")
    none = F.lit(None)
    dealt = left.where("not is_node").select("shard", "is_node", "sequence", none.cast("int").alias("number"), none.cast("long").alias("id")).union(
        kept.select("shard", "is_node", none.cast("binary"), "number", "id"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "is_node")
    level = written(dealt.mapInArrow(lean(_indexer(longest)), PHRASES), "pairs")
    indexes = level.where("not is_node").select("shard", "is_node", "before", "after", "ids", "phrase")
    held = None
    for lengths in [range(2, 3), range(3, 4), range(4, longest + 1)]:
        if not lengths or lengths[0] > longest:
            break
        if lengths[0] > 2:
            known = level.where("is_node").join(_to_join(found[-1].select("phrase"), 60), "phrase", "left_semi")
            known = written(known.select("shard", "phrase"), "kept")
            held = known if held is None else held.union(known)
            rows = held.select("shard", F.lit(True).alias("is_node"), *[none.cast("binary").alias(c) for c in ("before", "after", "ids")], "phrase")
            # Shards without a frequent phrase have nothing to extend.
            dealt = indexes.union(rows).repartition("shard").sortWithinPartitions("shard", "is_node")
            level = written(dealt.mapInArrow(lean(_extender(lengths)), PHRASES), "longer")
        counts = level.where("is_node").groupBy("phrase").agg(F.sum("size").alias("total"))
        found.append(written(counts.where(F.col("total") >= least), "phrases"))
    everything = found[0]
    for more in found[1:]:
        everything = everything.union(more)
    return everything, words, totals


def in_words(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Add `lang` and `text` to rows with a `phrase` of ids."""
    places = phrases.select("phrase", F.explode(F.sequence(F.lit(0), F.expr("length(phrase) div 4 - 1"))).alias("place"))
    places = places.withColumn("id", F.conv(F.hex(F.expr("substring(phrase, 4 * place + 1, 4)")), 16, 10).cast("long"))
    named = places.join(words.select("id", "lang", "word"), "id").groupBy("phrase").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("text"))
    return phrases.join(named, "phrase")


def collocations(df: DataFrame, least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the `first` phrases of 2 to `longest` words of each language, by score, then a, then phrase.

    a, l and r count the phrase and its two parts at the `cut` (words before it) with the lowest floor(1000 a n / (l r)), n all words
    of the language. Phrases inside a longer frequent one with the same count are left out: a count never grows with
    length, so it is enough to look at those that are one word longer.

    `df`: lang, text; other columns are not looked at. Null text is empty, a null language is `und`; repeated rows count each time;
    phrases are told apart by their bytes. An empty table, or one without frequent phrases, gives no rows.
    """
    known, words, totals = frequent_phrases(df, least, longest)
    size = "length(phrase) div 4"
    candidates = known.where(f"{size} > 1")
    inner = candidates.where(f"{size} > 2").select(F.explode(F.array(
        F.expr("substring(phrase, 1, length(phrase) - 4)"), F.expr("substring(phrase, 5)"))).alias("phrase"), "total")
    open_ones = written(in_words(candidates.join(inner.distinct(), ["phrase", "total"], "left_anti"), words), "open")
    cuts = open_ones.select("phrase", "lang", "text", F.col("total").alias("a"), F.explode(F.expr(f"sequence(1, cast({size} - 1 as int))")).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring(phrase, 1, 4 * cut)")).withColumn("right", F.expr("substring(phrase, 4 * cut + 1)"))
    scored = (cuts.join(known.select(F.col("phrase").alias("left"), F.col("total").alias("l")), "left")
              .join(known.select(F.col("phrase").alias("right"), F.col("total").alias("r")), "right")
              .join(totals, "lang"))
    # Whole numbers of up to 37 digits: counts below 10^15.
    wide = "decimal(18, 0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = scored.groupBy("lang", "text", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    ranked = first_per_key(best.select("lang", F.col("text").alias("phrase"), "a", "best.l", "best.r", "n", "best.score", "best.cut"), ["lang"],
                           [F.desc("score"), F.desc("a"), F.col("phrase")], first, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("bigint").alias("cut"))

"""Language-model scores with a log-frequency Bloom filter.

Texts are tokenised once, block by block: a block is some megabytes of text with a dictionary of its own. Word and word-pair
counts are summed over the blocks by hash range, so a word comes up once per block however common it is. Each range
of pairs becomes segments of a Bloom filter: a count is rounded down to a level on a logarithmic scale, and a pair is entered once
for each level up to its own. A segment's size follows from its entries. The blocks send the pairs they will ask for, held-out ones too,
to their range, where a pair's level is found by probing level after level until one is missing; so no task holds more than
a segment of the filter, however large the corpus. Levels of pairs and exact counts of words come back to the blocks.

The probability of a word w after h is (c(h,w) + K p(w)) / (c(h) + K), with p(w) the smoothed share of w and
K = 5 c(h)^0.8 + 2: what is not seen after h falls back to p. A false probe (about one of a thousand, see `ENTRY_BITS`) takes a pair one
level up; counts are never below the level that was entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stockroom.llm.common import lean, partitions, slices, strings, written

BLOCK_BYTES = 1 << 22
#: Tokens of a block that are scored at once (a longer text stands alone).
SLICE_TOKENS = 1 << 17
FILTER_MB = 64
PROBES = 6
#: Bits of the filter for each entry, at least.
ENTRY_BITS = 16
#: Pairs of a range that are entered and probed at once.
SEGMENT_PAIRS = 1 << 21
#: Levels of counts: the least count of each.
LEVELS = np.unique(np.ceil(1.5 ** np.arange(120)).astype(np.float64))
#: What a level stands for: the middle of its counts.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])
END, START = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
PAIR = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD1B54A32D192ED03
WORDS, PAIRS, SINGLE_PAIRS, HELD_PAIRS = range(4)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pair_keys(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of every token with the one before it (a start mark at the first of a text)."""
    h = words[tokens]
    before = np.concatenate([[START], h[:-1]]) if len(h) else h
    before[np.cumsum(lengths) - lengths] = START
    return mixed(before * PAIR + h)


def filter_places(h: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """Places of hashes in their segment."""
    x = mixed(h + np.uint64(level * STEP % 2 ** 64))
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return ((high + np.uint64(probe) * (low | np.uint64(1)) & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The filter segment of one range of keys, as bytes."""
    level = np.searchsorted(LEVELS, counts, "right")
    out = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        keys = keys[level >= j]
        level = level[level >= j]
        for k in range(PROBES):
            out[filter_places(keys, j, k, bits)] = True
    return np.packbits(out)


def found_counts(chunks: list[bytes], keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Counts of sorted keys by repeated probes: level after level, until a probe fails. A chunk holds the segments of some ranges in a row."""
    level, each = np.zeros(len(keys), np.int64), len(chunks[0]) * 8 // bits
    at = range_of(keys, ranges)
    edges = np.searchsorted(at, np.arange(len(chunks) + 1) * each)
    for c, chunk in enumerate(chunks):
        data, alive = np.frombuffer(chunk, np.uint8), np.arange(edges[c], edges[c + 1])
        base = (at[alive] - c * each) * bits
        for j in range(1, len(VALUES)):
            for k in range(PROBES):
                place = base[alive - edges[c]] + filter_places(keys[alive], j, k, bits)
                alive = alive[(data[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)]
            if not len(alive):
                break
            level[alive] = j
    return VALUES[level]


def found_levels(keys: np.ndarray, counts: np.ndarray, least_bits: int) -> np.ndarray:
    """Levels of one range's sorted keys, probed in filter segments of those that have a count."""
    out = np.zeros(len(keys), np.uint8)
    for low in range(0, len(keys), SEGMENT_PAIRS):
        some, number = keys[low:low + SEGMENT_PAIRS], counts[low:low + SEGMENT_PAIRS]
        entries = int(np.searchsorted(LEVELS, number, "right").sum())
        bits = -(-max(64, least_bits * len(some) // len(keys), ENTRY_BITS * entries) // 64) * 64
        data = segment(some[number > 0], number[number > 0], bits).tobytes()
        out[low:low + len(some)] = np.searchsorted(VALUES, found_counts([data], some, 1, bits))
    return out


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers with all low bytes first: compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def held_out(doc_id: Column) -> Column:
    """Rows the model does not learn from. Rows without an id are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def blocks(df: DataFrame) -> DataFrame:
    """(block, ids, held, lengths, tokens, words): texts as numbers into the block's list of word hashes."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, at = {}, 0, TaskContext.get().partitionId() << 32
        ids, held, texts = [], [], []

        def block() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            words = np.concatenate([[END], hashes + (hashes == END) + (hashes == START)])
            flat = np.concatenate(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([_planes(flat)], pa.binary()),
                 pa.array([words.tobytes()], pa.binary())], ["block", "ids", "held", "lengths", "tokens", "words"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for low in range(0, batch.num_rows, 200):  # few rows at a time are Python objects
                some = batch.slice(low, 200)
                for doc, test, text in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strings(some.column(1))):
                    raw = text.encode()
                    ids.append(doc)
                    held.append(test)
                    texts.append(np.array([number.setdefault(w, len(number) + 1) for w in raw.lower().split()] + [0], np.uint32))
                    size += len(raw) + 64
                    if size >= BLOCK_BYTES:
                        yield block()
                        number, size, at = {}, 0, at + 1
                        ids, held, texts = [], [], []
        if ids:
            yield block()

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(
        lean(run), f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, tokens binary, words binary")


def _by_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted hashes, and the end."""
    return np.searchsorted(range_of(h, ranges), np.arange(ranges + 1))


def count_blocks(texts: DataFrame, ranges: int, least_bits: int) -> DataFrame:
    """(kind, block, range, data, words, tokens): per block and range the counts of its words (kind WORDS) and the levels of its pairs (kind
    PAIRS) in the order of their hashes; without a block, per range its number of distinct words and of tokens in the training texts."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, lengths = batch.column(0)[k].as_py(), batch.column(2)[k].values.to_numpy()
                tokens, words = _unplaned(batch.column(3)[k].as_py()), np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                learnt = np.repeat(~batch.column(1)[k].values.to_numpy(zero_copy_only=False), lengths)
                counts = np.bincount(tokens[learnt], minlength=len(words))
                order = np.argsort(words)
                keys = pair_keys(words, tokens, lengths)
                held, keys = keys[~learnt], np.sort(keys[learnt])
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                number, keys = np.diff(np.r_[first, len(keys)]), keys[first]
                held = np.setdiff1d(held, keys)
                out: list[tuple[int, int, bytes]] = []
                for kind, h, n in ((WORDS, words[order], counts[order]), (PAIRS, keys[number > 1], number[number > 1]),
                                   (SINGLE_PAIRS, keys[number == 1], None), (HELD_PAIRS, held, None)):
                    edges = _by_range(h, ranges)
                    for r, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
                        if e > s:
                            out.append((kind, r, h[s:e].tobytes() + (n[s:e].astype("<u4").tobytes() if n is not None else b"")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), pa.array([block] * len(out), pa.int64()),
                     pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["kind", "block", "range", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for kind, block, r, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                size = len(data) // (12 if kind in (WORDS, PAIRS) else 8)
                n = np.frombuffer(data, "<u4", size, 8 * size) if kind in (WORDS, PAIRS) else np.full(size, kind == SINGLE_PAIRS, np.uint32)
                parts.setdefault((r, min(kind, PAIRS)), []).append((block, np.frombuffer(data, np.uint64, size), n))
        for r in sorted({k[0] for k in parts}):
            distinct = total = 0
            if mine := parts.pop((r, WORDS), None):
                words, inverse = np.unique(np.concatenate([m[1] for m in mine]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([m[2] for m in mine])).astype(np.int64)
                distinct, total = int((counts > 0).sum()), int(counts.sum())
                back, at = counts[inverse], 0
                for block, h, _ in mine:
                    yield row(WORDS, block, r, back[at:at + len(h)].astype("<i8").tobytes(), 0, 0)
                    at += len(h)
            if mine := sorted(parts.pop((r, PAIRS), ()), key=lambda m: m[0]):
                edges = np.r_[0, np.cumsum([len(m[1]) for m in mine])]
                block, first = np.unique([m[0] for m in mine], return_index=True)
                keys, inverse = np.unique(np.concatenate([m[1] for m in mine]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([m[2] for m in mine]))
                del mine
                levels = found_levels(keys, counts, least_bits)
                for b, s, e in zip(block.tolist(), edges[first], edges[np.r_[first[1:], -1]]):
                    yield row(PAIRS, b, r, levels[np.sort(inverse[s:e])].tobytes(), 0, 0)
            yield row(WORDS, None, r, b"", distinct, total)

    def row(kind, block, r, data, words, tokens) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([r], pa.int32()), pa.array([data], pa.binary()),
             pa.array([words], pa.int64()), pa.array([tokens], pa.int64())], ["kind", "block", "range", "data", "words", "tokens"])

    packed = texts.select("block", "held", "lengths", "tokens", "words").mapInArrow(lean(local), "kind int, block long, range int, data binary")
    return packed.repartitionById(ranges, F.col("range")).mapInArrow(
        lean(summed), "kind int, block long, range int, data binary, words long, tokens long")


def score_documents(df: DataFrame, filter_mb: int = FILTER_MB) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    `filter_mb` is the least size of the whole filter; it grows with the entries to `ENTRY_BITS` for each, and lies in the ranges' tasks
    segment by segment. Words are ASCII lower-cased runs without ASCII
    white space, known by 64-bit hashes; each text ends with one end token. Null or empty text is that token alone. Rows with a null or
    repeated doc_id are documents of their own; those without an id are learnt from. Without training rows every score is the base
    score. An empty table gives no rows.
    """
    ranges = partitions(df, 16)
    texts = written(blocks(df.select("doc_id", "text")), "blocks")
    counted = written(count_blocks(texts, ranges, filter_mb * 2 ** 23 // ranges), "counts")
    sums = counted.where("block is null").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    distinct, total = sums["words"] or 0, sums["tokens"] or 0
    counted = counted.where("block is not null")
    learnt = texts.select(F.explode("held").alias("held")).where("not held").count()

    def texts_of(counts: np.ndarray, tokens: np.ndarray, levels: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Of some texts of a block: known tokens, base scores, scores."""
        first = np.cumsum(lengths) - lengths
        count = counts[tokens]
        share = (count + 0.5) / (total + 0.5 * (distinct + 1))
        before = np.concatenate([[0.0], count[:-1]])
        before[first] = learnt
        pairs = np.minimum(np.minimum(VALUES[levels], before), count)
        back = 5 * before ** 0.8 + 2
        likely = (pairs + back * share) / (before + back)
        return [np.add.reduceat(v, first) for v in ((count > 0).astype(np.int64), np.log10(share), np.log10(likely))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, held = batch.column(0)[k].values, batch.column(1)[k].values
                lengths = batch.column(2)[k].values.to_numpy()
                tokens, words = _unplaned(batch.column(3)[k].as_py()), np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                counts = np.zeros(len(words))
                counts[np.argsort(words)] = np.concatenate([np.frombuffer(p["data"], "<i8") for p in batch.column(5)[k].as_py()])
                _, inverse = np.unique(pair_keys(words, tokens, lengths), return_inverse=True)
                levels = np.concatenate([np.frombuffer(p["data"], np.uint8) for p in batch.column(6)[k].as_py()])[inverse]
                edges = np.concatenate([[0], np.cumsum(lengths)])
                parts = [texts_of(counts, tokens[edges[low]:edges[high]], levels[edges[low]:edges[high]], lengths[low:high]) for low, high in slices(edges, SLICE_TOKENS)]
                sums = [np.concatenate(s) for s in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), total, np.int64)), pa.array(sums[1]),
                     pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def of(kind: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("range", "data"))))

    back = counted.groupBy("block").agg(of(WORDS).alias("counts"), of(PAIRS).alias("levels"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return texts.join(back, "block").select("ids", "held", "lengths", "tokens", "words", "counts", "levels").mapInArrow(
        lean(score), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

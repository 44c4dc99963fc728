"""Packing documents into sequences of a fixed number of tokens, with certified bounds.

Documents become rows of token ids; only those longer than a sequence are cut. The pieces are dealt over partitions and
packed there by best fit, longest first. Dual-feasible functions give a lower bound on the sequences any packing of a
partition needs; a partition that meets its bound is certified. While the sum stays above the bound of the whole table,
the sequences with gaps are opened, their pieces are exchanged between fewer partitions and packed again. Only rows of
lengths move; the ids stay where they are and can be joined to the result (`sequences`).
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import kept, lean, slices, strings, written

#: Words whose ids a worker keeps (memory only).
KEPT_WORDS = 400_000
#: Words that the tokenizer is given at once: what it returns holds far more than the ids.
AT_ONCE = 4_000
#: Bytes of text that a task encodes at once.
TEXT_BYTES = 4 << 20
#: Pieces that one task packs at once.
PACK_ROWS = 100_000
#: Pieces that one task packs at most, in rounds after one that has saved nothing.
MOST_ROWS = 1_000_000
#: Sequences that a certified partition still gives up for the exchange.
OPEN_BINS = 16


class WordIds:
    """Token ids of whole texts. The tokenizer drops white space and never looks across it, so each word is encoded once
    and its ids (as bytes, unsigned 32-bit little-endian) are kept.

    Kept words have two generations: words in use move up into the younger one, and when that is full the older one goes.
    """

    # Characters at which Python splits words and the tokenizer does not.
    ODD = re.compile("[\x1c-\x1f]")
    # White space beyond ASCII; texts without it split at bytes.
    WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.plain, self.last = self._plain(Tokenizer, spec)
        self.marks = self._marks()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, kind, spec: str):
        """The model alone, for words of small Latin letters, with a mark on the ids that end a word; None if the tokenizer does more to them."""
        parts = json.loads(spec)
        suffix = parts["model"].get("end_of_word_suffix")
        if not suffix:
            return None, None
        before = parts["pre_tokenizer"] or {}
        split = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}]
        split += [step for step in before.get("pretokenizers", [before]) if step.get("type") == "ByteLevel" and not step["use_regex"]]
        pre = {"type": "Sequence", "pretokenizers": split}
        model = kind.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": pre, "post_processor": None, "added_tokens": []}))
        vocabulary = model.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        letters = [chr(c) for c in range(256) if self.easy(chr(c))]
        probes = letters + ["".join(letters), "".join(letters[::-1])] + [a + b for a in letters for b in letters]
        same = self._joined(model, last, probes) == self.whole(probes)
        return (model, last) if same else (None, None)

    def _marks(self) -> str:
        """The ASCII marks, if the tokenizer keeps any of them at the end of a word apart from the letters before them."""
        tails = [a + b for a in punctuation for b in ("", *punctuation)]
        letter = self.whole(["\xe9"])[0]
        same = self.whole(["\xe9" + t for t in tails]) == [letter + t for t in self.whole(tails)]
        return punctuation if same else ""

    @staticmethod
    def _joined(model, last: np.ndarray, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for low in range(0, len(words), AT_ONCE):
            ids = np.array(model.encode_batch_fast([" ".join(words[low:low + AT_ONCE])], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * (1 + np.flatnonzero(last[ids]))).tolist()
            out += [data[begin:end] for begin, end in zip([0, *ends], ends)]
        return out

    LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")

    @classmethod
    def easy(cls, word: str) -> bool:
        """Whether a word is made of small Latin letters, which no normal form changes."""
        return cls.LATIN.fullmatch(word) is not None

    def distinct(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words."""
        if self.plain is None:
            return self.whole(words)
        easy = [self.easy(w) for w in words]
        plain = iter(self._joined(self.plain, self.last, [w for w, e in zip(words, easy) if e]))
        other = iter(self.whole([w for w, e in zip(words, easy) if not e]))
        return [next(plain if e else other) for e in easy]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for low in range(0, len(texts), AT_ONCE)
                for e in self.tokenizer.encode_batch_fast(texts[low:low + AT_ONCE], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, a few texts at a time so that a batch of long texts stays small."""
        out, low = [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= 1 << 22):
                size += len(texts[high])
                high += 1
            out += self._some(texts[low:high])
            low = high
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if self.ODD.search(t)]
        left = set(odd)
        plain = [i for i in range(len(texts)) if i not in left]
        lowered = [self._lowered(texts[i]) for i in plain]
        split = pc.ascii_split_whitespace(pa.array([t if t.isascii() or not self.WIDE.search(t) else " ".join(t.split()) for t in lowered], pa.large_string()))
        words = split.values.dictionary_encode()
        data = self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # The ids of every word in its place, one behind the other.
        ids = pa.array(data, pa.large_binary()).take(words.indices)
        if len(ids):
            _, places, whole = ids.buffers()
            borders = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
            raw = memoryview(whole) if whole is not None else b""
        out = [b""] * len(texts)
        for n, i in enumerate(plain if len(ids) else ()):
            out[i] = bytes(raw[borders[n]:borders[n + 1]])
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return out

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, in their order."""
        if len(self.young) > KEPT_WORDS // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young[""] = b""
        out = list(map(young.get, words))
        missing = []
        for i in [i for i, data in enumerate(out) if data is None]:
            data = old.get(words[i])
            if data is None:
                missing.append(i)
            else:
                out[i] = young[words[i]] = data
        # Letters and the marks after them are encoded apart, so a word that is known does it.
        marked, rest = [], {}
        for i in missing:
            word = words[i]
            letters = word.rstrip(self.marks)
            if len(letters) < len(word) and letters.isalpha():
                marked.append((i, letters, word[len(letters):]))
                rest[letters] = rest[word[len(letters):]] = None
            else:
                rest[word] = None
        rest = [w for w in rest if w not in young]
        young.update([(w, old[w]) for w in rest if w in old])
        rest = [w for w in rest if w not in old]
        if rest:
            young.update(zip(rest, self.distinct(rest)))
        for i, letters, tail in marked:
            young[words[i]] = young[letters] + young[tail]
        for i in missing:
            out[i] = young[words[i]]
        return out

    @staticmethod
    def _lowered(text: str) -> str:
        """The tokenizer puts letters in lower case itself; done before, fewer words differ. Special tokens must keep their case, and
        outside Latin-1 lower case is not a matter of single letters."""
        if "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `TEXT_BYTES` of text in column 1 (a longer text stands alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for low, high in slices(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), TEXT_BYTES):
        yield batch.slice(low, high - low)


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    Null text is empty: one piece that holds the end id only. Rows with a null or repeated doc_id are documents of their own.
    `ids` are the piece's ids as unsigned 32-bit little-endian bytes.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    shared = df.sparkSession.sparkContext.broadcast((hashlib.sha256(spec.encode()).hexdigest(), spec))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, spec = shared.value
        coder = kept("words", digest, lambda: WordIds(spec))
        for batch in (part for whole in batches for part in _parts(whole)):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(coder.encode(strings(batch.column(1)))):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select("doc_id", "text").mapInArrow(lean(run, "words"), schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, for `counts[n]` pieces of length n: the best of two families of dual-feasible functions."""
    if not counts.sum():
        return 0
    counts = counts.astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    # Pieces longer than capacity - t count as full, those shorter than t as nothing.
    t = np.arange(0, capacity // 2 + 1)
    full = number[-1] - number[capacity - t + 1]
    best = int(np.max(-((-(capacity * full + mass[capacity - t + 1] - mass[t])) // capacity)))
    # Lengths rounded down to multiples of 1/(k+1) and scaled to k parts.
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        worth = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        total = int(np.dot(worth, counts))
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each piece's bin and offset, and each bin's free room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms = 0  # bit r: some bin has r free
    free: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add (sequence_id, offset) to rows that have a `length` from 1 to `capacity`; all other columns are kept.

    `pieces` is read several times, so it should be a written table. Ties and repeated rows are packed like any others;
    an empty table gives no rows. Each round deals the rows that are still open over as few partitions as hold them, `PACK_ROWS` each, and over half
    as many after a round that has saved nothing, down to `MOST_ROWS` each. The loop ends when the number of sequences equals the bound of the
    whole table, with the round in which all open rows fit one task, or when a round with `MOST_ROWS` each has saved nothing.
    """
    names = pieces.columns
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)
    spans = pieces.schema.simpleString()[len("struct<"):-1]
    schema = f"{spans}, sequence_id long, offset long, open boolean"

    def packer(round_no: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks()
            lengths = table.column("length").to_numpy()
            at, offset, free = best_fit(lengths, capacity)
            # A certified partition opens its emptiest sequences only; one with a gap opens all that have room.
            certified = len(free) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            opened = free > 0
            if certified:
                opened &= np.isin(np.arange(len(free)), np.argsort(-free, kind="stable")[:OPEN_BINS])
            base = (round_no << 56) + (TaskContext.get().partitionId() << 32)
            for name, values in (("sequence_id", at + base), ("offset", offset), ("open", opened[at])):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches(max_chunksize=10_000)
        return run

    closed, pool, settled, before, round_no = [], pieces, 0, None, 0
    count = max(1, math.ceil(int(counts.sum()) / PACK_ROWS))
    least = max(1, math.ceil(int(counts.sum()) / MOST_ROWS))
    while True:
        round_no += 1
        done = written(pool.select(*names).repartition(count, F.xxhash64(F.lit(round_no), F.monotonically_increasing_id())).mapInArrow(lean(packer(round_no)), schema), f"packed-{round_no}")
        made = done.select("sequence_id", "open").distinct().agg(
            F.count("*").alias("bins"), F.count_if("open").alias("open")).first()
        used = settled + made["bins"]
        saved = before is None or used < before
        if used <= bound or count == 1 or not saved and count <= least:
            closed.append(done)
            break
        closed.append(done.filter("not open"))
        settled, before = used - made["open"], used
        pool = done.filter("open")
        rows = pool.count()
        least = max(1, math.ceil(rows / MOST_ROWS))
        count = max(least, min(count, math.ceil(rows / PACK_ROWS)) // (1 if saved else 2))
    result = closed[0]
    for more in closed[1:]:
        result = result.unionByName(more)
    return result.drop("open")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(written(token_pieces(df, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame, df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence as unsigned 32-bit little-endian bytes.

    `packed` comes from `pack_documents` over the same `df`, whose doc_id must be unique.
    """
    ids = token_pieces(df, tokenizer_path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))

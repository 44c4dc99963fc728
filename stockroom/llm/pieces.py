"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A sequence of pieces is the merge result of its text exactly if every two neighbours, joined and merged anew, come
out as the same two pieces. So a text is encoded by taking the longest piece at each place (an Aho-Corasick automaton
finds them), checking it against the piece before, and trying shorter pieces or going back where the check fails. A bit
field remembers the places from which no valid ending was found, so no place is tried twice.

A piece never reaches over a boundary of words (no piece has a space mark after another character, none holds a line
break), so words are encoded one at a time and their results are kept for the next time the word comes up.

Models with the identity normaliser, a dummy prefix and byte fallback are supported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from stockroom.llm.common import kept, lean, strings

MARK = "▁"
#: Words whose ids a worker keeps; beyond this the store is emptied (memory only, never the result).
KEPT_WORDS = 300_000
KEPT_PAIRS = 1_000_000


class Pieces:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = known.get_piece_size()
        names = [known.id_to_piece(i) for i in range(size)]
        special = [known.is_control(i) or known.is_unknown(i) or known.is_byte(i) for i in range(size)]
        self.bos, self.eos = known.bos_id(), known.eos_id()
        self.ids = {names[i]: i for i in range(size) if not special[i]}
        self.scores = {names[i]: known.get_score(i) for i in range(size) if not special[i]}
        self.bytes = [known.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) or " " in p for p in self.ids):
            raise ValueError("a piece of this model reaches over a word boundary")
        self.letters = {c for p in self.ids for c in p}
        self.breaks = "\n" not in self.letters
        # Decoding: each id's own bytes. Control ids stand for nothing.
        self.shown = [b"" if known.is_control(i) else (b" \xe2\x81\x87 " if known.is_unknown(i) else names[i].replace(MARK, " ").encode())
                      for i in range(size)]
        for b, i in enumerate(self.bytes):
            self.shown[i] = bytes([b])
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.bytes] = True
        self.blank = np.zeros(size, bool)
        self.blank[[i for i in range(size) if known.is_control(i)]] = True
        self.marked = np.array([not special[i] and names[i][:1] == MARK for i in range(size)])
        # Only pieces that merging really makes may be used.
        self.finder = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        usable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        #: Each prefix of a piece, and the longest usable piece that starts it.
        self.best: dict[str, str] = {}
        for p in usable:
            self.finder.add_word(p, p)
            for n in range(1, len(p) + 1):
                if p[:n] not in self.best:
                    self.best[p[:n]] = next((p[:m] for m in range(n, 0, -1) if p[:m] in usable), "")
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in usable), None)
        self.finder.make_automaton()
        self.longest = max(map(len, usable))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.runs: dict[int, list[int]] = {}

    def merge(self, text: str) -> list[str]:
        """Merging as the model defines it: the best-scored neighbours first, the leftmost of equals."""
        parts, none = list(text), float("-inf")
        score = self.scores.get
        pairs = [score(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged anew."""
        pair = (left, right)
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = self.merge(left + right) == [left, right]
        return found

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text of known letters only."""
        greedy = [piece for _, piece in self.finder.iter_long(text)]
        pairs, fits, shorter = self.pairs, self.fits, self.shorter
        for k in range(len(greedy) - 1):
            pair = (greedy[k], greedy[k + 1])
            ok = pairs.get(pair)
            if not (fits(*pair) if ok is None else ok):
                break
        else:
            return greedy  # the longest pieces fit at every place: nothing to take back
        taken, piece = greedy[:k + 1], greedy[k + 1]
        at, size = sum(map(len, taken)), len(text)
        last, open_ends = taken[-1], (1 << size + 1) - 1
        while True:
            while piece is not None:
                end = at + len(piece)
                if open_ends >> end & 1:
                    if last is None:
                        break
                    ok = pairs.get((last, piece))
                    if fits(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            if piece is None:  # nothing fits from here on: close this place and take the piece before back
                open_ends &= ~(1 << at)
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else None
            else:
                taken.append(piece)
                if end == size:
                    return taken
                at, last, rest = end, piece, text[end:end + self.longest]
                piece = self.best[rest[:self.finder.longest_prefix(rest)]]

    def known_run(self, text: str) -> list[int]:
        """The ids of text without space marks but perhaps with one in front; letters that no piece has become bytes."""
        out: list[int] = []
        if self.letters.issuperset(text):
            return [self.ids[p] for p in self.backtrack(text)] if text else out
        start = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                out += [self.ids[p] for p in self.backtrack(text[start:i])] if i > start else []
                out += [self.bytes[b] for b in c.encode()]
                start = i + 1
        return out + ([self.ids[p] for p in self.backtrack(text[start:])] if start < len(text) else [])

    def marks(self, count: int) -> list[int]:
        """The ids of a run of space marks only. Such pieces share one score, so runs are merged directly.

        A long run starts with as many of the longest mark piece as merging from the left gives.
        """
        if count not in self.runs:
            parts, most = [], max(len(p) for p in self.ids if not p.strip(MARK))
            rest = count
            while rest > 4 * most:
                parts.append(MARK * most)
                rest -= most
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[count] = [self.ids[p] for p in parts + (self.merge(MARK * rest) if rest else [])]
        return self.runs[count]

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of space marks and the characters up to the next ones."""
        count = len(word) - len(word.lstrip(MARK))
        if count < 2:
            return tuple(self.known_run(word))
        if count == len(word):
            return tuple(self.marks(count))
        ids = self.known_run(word[count - 1:])
        alone = ids[0] == self.ids[MARK]  # the mark before the word was not taken into its first piece
        return tuple(self.marks(count if alone else count - 1) + ids[alone:])

    def found(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            if word[:1] == "\n" and self.breaks:
                ids = self.words[word] = (self.bytes[10], *self.word(word[1:]))
            else:
                ids = self.words[word] = self.word(word)
        return ids

    def encode(self, text: str, ends: bool = False) -> list[int]:
        """The ids of a text, with begin and end ids if `ends`."""
        out = [self.bos] if ends else []
        if text:
            if MARK in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or not self.breaks:
                words = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", MARK + text.replace(" ", MARK))
            else:  # the common case, cut by one split: each part is a word with its mark, or a line break and a word
                words = text.replace("\n", " \n").split(" ")
                words = [w if w[:1] == "\n" else MARK + w for w in words]
            get, found = self.words.get, self.found
            for w in words:
                out += get(w) or found(w)
        if ends:
            out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space marks are spaces, the one in front is dropped, broken bytes become U+FFFD."""
        if not ids:
            return ""
        at = np.fromiter(ids, np.int64, len(ids))
        plain = at[~self.blank[at]]
        if not len(plain):
            return ""
        raw = b"".join(map(self.shown.__getitem__, plain.tolist()))
        if self.marked[plain[0]]:
            raw = raw[1:]
        if self.is_byte[plain].any():
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return self._mended(at.tolist())
        return raw.decode()

    def _mended(self, ids: list[int]) -> str:
        """As `decode`, where bytes do not make whole characters: each byte that fits nowhere is one U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                lead = run[at]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                try:
                    out.append(run[at:at + size].decode())
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()

        for k, i in enumerate(ids):
            if self.is_byte[i]:
                run += self.shown[i]
            else:
                flush()
                out.append(self.shown[i].decode()[int(k == 0 and self.marked[i]):])
        flush()
        return "".join(out)


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _coder(shared) -> Pieces:
    digest, model = shared.value
    return kept("pieces", digest, lambda: Pieces(model))


def _shared(df: DataFrame, path: str):
    model = _model(path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model))


def encode_documents(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
                     ends: bool = True) -> DataFrame:
    """One row (id, ids array<int>) per row of `df`. Null text is empty; repeated and null ids are kept as they are."""
    shared = _shared(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            ids = [coder.encode(t, ends) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(lean(run, "pieces"), f"`{id_column}` {kind}, ids array<int>")


def decode_documents(df: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row (id, text) per row of ids. Null ids decode to the empty text."""
    shared = _shared(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            texts = [coder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(lean(run, "pieces"), f"`{id_column}` {kind}, text string")


def round_trip_digests(df: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded with both ends and decoded again.

    Both steps run in one pass, so ids never leave the worker. Null text is empty: two ids, the digest of no text.
    An empty table gives no rows.
    """
    shared = _shared(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for text in strings(batch.column(1)):
                ids = coder.encode(text, ends=True)
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(lean(run, "pieces"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

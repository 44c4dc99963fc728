"""Removing lines (or paragraphs) and sentences that an earlier document already has.

A text is cut into units of two levels: its lines, and the sentences within a line. A unit is normalised (ASCII letters in lower case, white
space as one space, trimmed) and hashed; the digests are grouped over the whole corpus, the occurrence that ranks first (smallest
doc_id, then the earlier place) stays and all others go. Every line that is not blank counts; a sentence counts from `sentence_words` words
on, since shorter ones come up everywhere. Both levels are judged on the input, so what goes is the union of both: a line that repeats holds only
sentences that repeat. The removed stretches keep their offsets in the input.

Units are cut and hashed as bytes in Arrow batches. Digests are computed once and written. Only digests and places are shuffled; those of very
frequent units, of which there can only be a few, are met by a broadcast instead, so one line that makes up a third of the corpus does not land in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import lean, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond ASCII keep their case.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
NO_ID = 2 ** 63 - 1
#: A sentence ends with one of these, the space belongs to it.
ENDS = (b". ", b"! ", b"? ")
#: A byte that no text in UTF-8 holds.
BORDER = b"\xff"
#: Places that a task hands on at once.
PLACE_ROWS = 100_000
#: A unit with more than this part of all places is met by broadcast; there are fewer than its inverse.
FREQUENT = 1e-4

PLACES = "digest binary, place struct<doc:long,mark:long,line:int,sentence:int>"


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column, one at a time; null counts as the empty text."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _sentences(line: bytes) -> list[bytes]:
    for end in ENDS:
        line = line.replace(end, end + BORDER)
    return line.split(BORDER)


def _units(text: bytes, separator: bytes, sentence_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(line, sentence, digest) of every unit that counts; the line itself is sentence -1. White space is what `bytes.split` takes for it."""
    for i, line in enumerate(text.split(separator)):
        words = line.translate(FOLD).split()
        if not words:
            continue
        plain = b" ".join(words)
        yield i, -1, md5(b"l" + plain, usedforsecurity=False).digest()
        if len(words) < sentence_words:
            continue
        parts = _sentences(line)
        if len(parts) == 1:
            yield i, 0, md5(b"s" + plain, usedforsecurity=False).digest()
            continue
        for j, part in enumerate(parts):
            words = part.translate(FOLD).split()
            if len(words) >= sentence_words:
                yield i, j, md5(b"s" + b" ".join(words), usedforsecurity=False).digest()


def _places(docs: DataFrame, separator: str, sentence_words: int) -> DataFrame:
    """(digest, place) of every unit; a place is (doc, mark, line, sentence), the line itself counts as sentence -1."""
    cut, least = separator.encode(), max(1, sentence_words)

    def rows(batch: pa.RecordBatch, row: list[int], found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        line, sentence, digest = zip(*found)
        at = pa.array(row, pa.int64())
        place = pa.StructArray.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(sentence, pa.int32())],
            ["doc", "mark", "line", "sentence"])
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), place], ["digest", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            found: list[tuple[int, int, bytes]] = []
            for i, text in enumerate(_texts(batch.column(2))):
                for unit in _units(text, cut, least):
                    row.append(i)
                    found.append(unit)
                    if len(row) >= PLACE_ROWS:
                        yield rows(batch, row, found)
                        row, found = [], []
            if row:
                yield rows(batch, row, found)

    return docs.select("doc", "mark", "row.text").mapInArrow(lean(run), PLACES)


def drop_repeated_units(df: DataFrame, separator: str = "\n", sentence_words: int = 8) -> DataFrame:
    """(row, kept, n_units, removed, removed_words): each row of `df` as a struct, its remaining text, the number of its units, the removed
    stretches [start, end) in characters of the input, and the words in them.

    `separator` is a line break for lines or two for paragraphs; kept lines are joined by it. A removed line is one stretch, whatever its
    sentences are. Null text is empty. A row without doc_id ranks last; rows with one doc_id are ranked by a mark of their text;
    rows that repeat both are one document and get the same result. An empty table gives no rows. `df` is read twice.
    """
    docs = df.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                     F.xxhash64("text").alias("mark"))
    places = written(_places(docs, separator, sentence_words), "places")
    firsts = places.groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = written(firsts.where("first <> last").select("digest", "n", "first"), "firsts")
    limit = places.count() * FREQUENT
    often = F.broadcast(firsts.where(F.col("n") > limit).select("digest", F.col("first").alias("often")))  # fewer than 1 / FREQUENT rows
    seldom = firsts.where(F.col("n") <= limit).select("digest", "first")
    met = places.join(often, "digest", "left")
    gone = met.where("place <> often").select("place").union(
        met.where("often is null").join(seldom, "digest").where("place <> first").select("place"))
    units = gone.groupBy("place.doc", "place.mark").agg(F.collect_set(F.struct("place.line", "place.sentence")).alias("units"))
    joined = docs.join(written(units, "units"), ["doc", "mark"], "left").select("row", "units")
    cut = separator.encode()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(0).field("text"))
            found = [_without(text, drop or (), cut, sentence_words) for text, drop in zip(texts, batch.column(1).to_pylist())]
            kept, number, removed, words = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(number, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(words, pa.int64())],
                ["row", "kept", "n_units", "removed", "removed_words"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(lean(keep), f"row {row}, kept string, n_units long, removed array<struct<start:long,end:long>>, removed_words long")


def _without(text: bytes, drop: list[dict], separator: bytes, sentence_words: int) -> tuple[bytes, int, list[dict], int]:
    gone = {(d["line"], d["sentence"]) for d in drop}
    chars = len if text.isascii() else lambda part: len(part.decode())
    lines, at, units, kept, removed, words = text.split(separator), 0, 0, [], [], 0
    for i, line in enumerate(lines):
        held = len(line.split())
        units += held > 0
        parts = _sentences(line) if held >= sentence_words else [line]
        sizes = [len(p.split()) for p in parts] if len(parts) > 1 else [held]
        units += sum(s >= sentence_words for s in sizes)
        size = chars(line) if gone else 0
        if (i, -1) in gone:
            removed.append({"start": at, "end": at + size})
            words += held
        elif not gone:
            kept.append(line)
        else:
            begin, left = at, []
            for j, (part, number) in enumerate(zip(parts, sizes)):
                end = begin + chars(part)
                if (i, j) in gone:
                    removed.append({"start": begin, "end": end})
                    words += number
                else:
                    left.append(part)
                begin = end
            kept.append(b"".join(left))
        at += size + len(separator.decode())
    return separator.join(kept), units, removed, words


def line_report(df: DataFrame, sentence_words: int = 8) -> DataFrame:
    """(doc_id, n_units, n_removed, removed_words, removed_chars, removed_spans, kept_text); spans as text, start:end joined by commas."""
    done = drop_repeated_units(df.select("doc_id", "text"), sentence_words=sentence_words)
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("row.doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "removed_words", chars.alias("removed_chars"),
                       F.array_join(spans, ",").alias("removed_spans"), F.col("kept").alias("kept_text"))

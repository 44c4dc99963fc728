"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models give the probability of each letter after the six before it in its word: one learnt from toxic texts, one from
ordinary ones. Both discount their own counts and back off to the same lower orders, which count in how many
different contexts of either class a sequence of letters was met. So a rare word costs both models about the same, and only
letters that one class really prefers tell. The log-likelihood ratio of a text is normalised by its length; with
the ratio of its most telling words it enters a logistic curve, fitted on texts that the models had not seen.

The models are learnt from a bounded sample of labelled rows (`max_rows`); scoring covers every text in full.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockroom.llm.common import kept, lean, strings, written

ORDER = 7
#: Taken off counts of one, two, and three or more.
DISCOUNTS = np.array([0.0, 0.95, 1.4, 1.8])
SHARED_DISCOUNT = 0.75
MAX_ROWS = 4_000
#: Parts of the sample; each is judged by models of the others when the curve is fitted.
FOLDS = 4
RIDGE = 1.0
#: Words whose ratio a worker keeps (memory only).
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
#: An odd multiplier for rolling hashes of letters.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


class Letters:
    """The letters of words, with marks before and after, and hashes of the last few letters at any of them."""

    def __init__(self, words: list[str]):
        pad = START * (ORDER - 1)
        self.text = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(self.length + ORDER - 1)
        step = np.arange(self.length.sum()) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        #: Places of the letters that are predicted.
        self.at = np.repeat(ends - self.length, self.length) + step

    def grams(self, order: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the last `order` letters up to the places."""
        h = np.zeros(len(at), np.uint64)
        for back in range(order - 1, -1, -1):
            h *= BASE
            h += self.text[at - back].astype(np.uint64) + np.uint64(1)
        return mixed(h + np.uint64(order))


def learnt(words: list[str], ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """The log ratio of every sequence of letters met (sorted hashes, ratios), and of every context for letters not met in it."""
    letters = Letters(words)
    gram, place, inverse = np.unique(letters.grams(ORDER, letters.at), return_index=True, return_inverse=True)
    place = letters.at[place]
    counts = [np.bincount(inverse, np.repeat(n, letters.length), len(gram)) for n in (ordinary, toxic)]
    # Shared lower orders: in how many different contexts a sequence was met.
    levels, at = [], place
    for order in range(ORDER - 1, 0, -1):
        _, first, low = np.unique(letters.grams(order, at), return_index=True, return_inverse=True)
        levels.append((low, np.bincount(low).astype(float), at[first], order))
        at = at[first]
    shared = np.array([1.0 / (len(levels[-1][1]) + 1)]) if levels else np.ones(1)
    for k, (low, number, at, order) in enumerate(reversed(levels)):
        _, context = np.unique(letters.grams(order - 1, at - 1), return_inverse=True)
        total, kinds = np.bincount(context, number)[context], np.bincount(context)[context]
        shorter = np.repeat(shared, len(number)) if k == 0 else shared[levels[len(levels) - k][0]]
        shared = np.maximum(number - SHARED_DISCOUNT, 0) / total + SHARED_DISCOUNT * kinds / total * shorter
    below = shared[levels[0][0]]
    contexts, context = np.unique(letters.grams(ORDER - 1, place - 1), return_inverse=True)
    likely, backoff = [], []
    for count in counts:
        off = np.minimum(count, DISCOUNTS[np.minimum(count, 3).astype(int)])
        total = np.bincount(context, count, len(contexts))
        rest = np.where(total > 0, np.bincount(context, off, len(contexts)) / np.maximum(total, 1), 1.0)
        likely.append((count - off) / np.maximum(total, 1)[context] + rest[context] * below)
        backoff.append(rest)
    return gram, np.log(likely[1] / likely[0]), contexts, np.log(backoff[1] / backoff[0])


class Ratios:
    """Log-likelihood ratios of words under a model, each computed once while it is kept."""

    def __init__(self, model: tuple[np.ndarray, ...]):
        self.gram, self.ratio, self.context, self.backoff = model
        self.words: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        letters = Letters(words)
        gram, context = letters.grams(ORDER, letters.at), letters.grams(ORDER - 1, letters.at - 1)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        other = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        ratio = np.where(self.gram[at] == gram, self.ratio[at],
                         np.where(self.context[other] == context, self.backoff[other], 0.0))
        self.words.update(zip(words, np.add.reduceat(ratio, np.cumsum(letters.length) - letters.length).tolist()))

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: ratio per letter, ratio per letter of the words that speak for toxic, log length, mean of the three most
        toxic words, mean of the most toxic fiftieth of its words."""
        out, low = np.zeros((len(texts), 5)), 0
        while low < len(texts):  # a few texts at a time, so that batches of long texts stay small
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= 1 << 22):
                size += len(texts[high])
                high += 1
            split = [WORD.findall(t.lower()) for t in texts[low:high]]
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            missing = list({w for words in split for w in words if w not in self.words})
            for k in range(0, len(missing), 20_000):
                self.learn(missing[k:k + 20_000])
            for i, words in enumerate(split, low):
                if words:
                    ratio = np.fromiter(map(self.words.__getitem__, words), float, len(words))
                    size = sum(map(len, words)) + len(words)
                    top = -np.sort(-ratio)
                    out[i] = (ratio.sum() / size, np.maximum(ratio, 0).sum() / size, np.log(size + 1), top[:3].sum() / 3,
                              top[:max(1, len(top) // 50)].mean())
            low = high
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from. Rows without an id cannot be labelled, and count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _fit(features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a ridge, which keeps small samples from deciding too much: mean, scale, weights."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.c_[np.ones(len(features)), (features - mean) / scale]
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + ridge
        weights += np.linalg.solve(curve, x.T @ (toxic - p) - ridge @ weights)
    return mean, scale, weights


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """(model, curve) learnt from at most `max_rows` labelled documents that are not held out, taken in the order of a hash of their id.

    A document labelled more than once is toxic if one label says so; null labels are left out. Without labels of both
    kinds in several parts there is nothing to compare, and the result is None.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # The hash that picks rows is not the one that deals them. At most max_rows rows are broadcast.
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % FOLDS
    sample = written(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", fold.cast("int").alias("fold")), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for text, group in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                for w in WORD.findall(text.lower()):
                    counts[w, group] = counts.get((w, group), 0) + 1
        keys = list(counts)
        for low in range(0, len(keys), 50_000):
            part = keys[low:low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part], pa.int32()),
                                              pa.array([counts[k] for k in part], pa.int64())], ["word", "part", "n"])

    parts = sample.select("text", (F.col("fold") * 2 + F.col("toxic")).alias("part")).mapInArrow(lean(words), "word string, part int, n long")
    table = parts.groupBy("word").pivot("part", list(range(2 * FOLDS))).sum("n").na.fill(0).toArrow()  # words of the bounded sample
    names = table.column(0).to_pylist()
    n = np.array([table.column(k).to_numpy() for k in range(1, 2 * FOLDS + 1)]).reshape(FOLDS, 2, -1)
    del table

    def model(without: int | None) -> tuple[np.ndarray, ...]:
        ordinary, toxic = n[[f for f in range(FOLDS) if f != without]].sum(axis=0)
        used = np.flatnonzero(ordinary + toxic)
        return learnt([names[i] for i in used], ordinary[used], toxic[used])

    if not len(names) or not all(n[[f for f in range(FOLDS) if f != without]].sum(axis=(0, 2)).all() for without in range(FOLDS)):
        return None
    shared = documents.sparkSession.sparkContext.broadcast([model(f) for f in range(FOLDS)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, toxic, texts = batch.column(2).to_numpy(), batch.column(1), strings(batch.column(0))
            rows = np.zeros((len(texts), 5))
            for k in range(FOLDS):  # each text is judged by the models of the other parts
                mine = np.flatnonzero(folds == k)
                rows[mine] = Ratios(shared.value[k]).features([texts[i] for i in mine])
            yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64())), toxic], ["features", "toxic"])

    scored = sample.mapInArrow(lean(score), "features array<double>, toxic int").toArrow()
    shared.destroy()
    curve = _fit(np.array(scored.column(0).to_pylist()), scored.column(1).to_numpy())
    return model(None), curve


def scores(documents: DataFrame, fitted) -> DataFrame:
    """Each row of `documents` as a struct, with its score from 0 to 1: (row, score).

    Null and empty texts have no words; they get what the curve says of a text without evidence. Without a fitted model every score
    is 0. Repeated rows and rows without doc_id are scored like any other; an empty table gives no rows.
    """
    rows = documents.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    if fitted is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    shared, token = documents.sparkSession.sparkContext.broadcast(fitted), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (mean, scale, weights) = shared.value
        ratios = kept("toxicity", token, lambda: Ratios(model))
        for batch in batches:
            x = (ratios.features(strings(batch.column(1))) - mean) / scale
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["row", "score"])

    return rows.mapInArrow(lean(run, "toxicity"), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = scores(documents.select("doc_id", "text"), fit(documents, labels, max_rows))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

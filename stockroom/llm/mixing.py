"""Mixing sources to target weights, with DataFrame expressions only.

The words of each source form one stream, cut into blocks of a fixed length. The mix is a row of slots, one block each, dealt
over output shards. Every shard draws how many of its slots go to each source (a multinomial draw by hashes); the
n-th slot of a source is mapped through the source's own pseudorandom index permutation, and the mapped index names a block. Blocks are
then joined by index, and what a document gives is the sum over its blocks.

A draw leaves each source a little over or under what its target asks for. Mapped indices past a source's quota are drawn anew for the
sources below theirs, so every source takes its target to the word and no block comes up more than once a round through its source.
The permutation is a swap-or-not shuffle: it maps any number of indices one to one, in a fixed number of expressions.

A source may hold any part of the rows: its stream is put together from chunks of hashed documents, and only one row per chunk
(or shard) and source is summed up over the source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockroom.llm.common import written
from stockroom.operators.numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a chunk, about.
CHUNK_ROWS = 4_000
#: Slots of an output shard.
SHARD_SLOTS = 256
#: Shards whose counts are summed up together.
SHARDS_TOGETHER = 4096
#: Parts of the quota table in which a draw is looked up.
CELLS = 4096
ROUNDS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


@dataclass
class Mix:
    """A mix, as tables. `sources`: source_no, source, source_size, target, words, slots. `documents`: doc_id, size, source_no,
    source_size, target, start (place in the source's stream). `slots`: shard, turn (order within the shard), source_no, block, words (of
    the block, from its first). `block`: words per block."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block: int


def water_level(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add `target` to sources that have a `source_size` and a `weight`.

    Sources in order of size by weight: one is full when the level that is left for it and those after it covers it.
    """
    cap = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = share * (whole["size"] or 0), float(whole["weight"] or 0)
    ranked = numbered(sources, [F.col("source_size") / F.col("weight"), F.col("source_no")], "_turn",
                      {"_caps": cap, "_weights": F.col("weight").cast("double")})
    level = (F.lit(total) - F.col("_caps") + cap) / (F.lit(weight) - F.col("_weights") + F.col("weight"))
    ranked = ranked.withColumn("_full", cap <= level * F.col("weight"))
    full = ranked.where("_full").agg(F.sum(cap).alias("caps"), F.sum("weight").alias("weights")).first()
    rest = weight - (full["weights"] or 0)
    last = (total - (full["caps"] or 0)) / rest if rest else 0.0
    return (ranked.withColumn("target", F.when(F.col("_full"), cap).otherwise(F.least(cap, F.lit(last) * F.col("weight"))))
            .drop("_turn", "_caps", "_weights", "_full"))


def shuffled(df: DataFrame, index: str, count: str, *keys: str, seed: int = 0) -> DataFrame:
    """Replace `index` (0 to `count` - 1) by its image under a permutation of these numbers that depends on `keys`.

    Each round pairs the indices x and k - x; a bit that belongs to the pair says whether its two sides change places.
    """
    def exchanged(x: Column, r: Column) -> Column:
        salt = [F.lit(seed), r, *map(F.col, keys)]
        other = F.pmod(F.pmod(F.xxhash64(*salt), F.col(count)) - x, F.col(count))
        return F.when(F.xxhash64(*salt, F.greatest(x, other)) > 0, other).otherwise(x)

    return df.withColumn(index, F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.col(index), exchanged))


def _before(df: DataFrame, value: str, name: str, keys: list[str], group: str, order: list[str]) -> DataFrame:
    """Sum of `value` over the rows of `keys` before each row, in order of `group` and then `order`: within groups, then over groups."""
    within = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(*keys, group).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, group, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_carry"))
    return (df.join(groups, [*keys, group])
            .withColumn(name, F.col("_carry") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_carry"))


def _sources(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """One row per source: number in order of code points (null last), sizes, target, quota of words and slots, first place in the draw."""
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = numbered(named, [F.col("source").isNull(), F.col("source")], "source_no").withColumn("source_no", F.col("source_no") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    aimed = water_level(named.withColumn("weight", weight), share, most)
    words, blocks = F.round("target").cast("bigint"), F.ceil(F.col("source_size") / block)
    aimed = aimed.withColumn("words", words).withColumn("blocks", blocks)
    # Whole rounds through the source, then as many words of a last round as are left.
    aimed = aimed.withColumn("_rounds", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
    aimed = aimed.withColumn("_left", F.col("words") - F.col("_rounds") * F.col("source_size"))
    aimed = aimed.withColumn("slots", F.col("_rounds") * F.col("blocks") + F.ceil(F.col("_left") / block))
    return numbered(aimed.drop("_rounds", "_left"), ["source_no"], "_row", {"_upto": F.col("slots")}).drop("_row").withColumn(
        "first_slot", F.col("_upto") - F.col("slots")).drop("_upto")


def _drawn(sources: DataFrame, total: int, seed: int) -> DataFrame:
    """(shard, source_no, draws): for every shard, a multinomial draw of its slots by the sources' quotas."""
    width = max(1, math.ceil(total / CELLS))
    cells = sources.where("slots > 0").select(
        "source_no", "first_slot", (F.col("first_slot") + F.col("slots")).alias("_end"),
        F.explode(F.expr(f"sequence(first_slot div {width}, (first_slot + slots - 1) div {width})")).alias("_cell"))
    draws = sources.sparkSession.range(total).select(
        F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("_at"))
    met = draws.withColumn("_cell", F.expr(f"_at div {width}")).join(cells, "_cell").where("_at >= first_slot and _at < _end")
    return met.groupBy("shard", "source_no").agg(F.count("*").alias("draws"))


def _slots(sources: DataFrame, total: int, block: int, seed: int) -> DataFrame:
    drawn = written(_drawn(sources, total, seed), "drawn")
    got = drawn.groupBy("source_no").agg(F.sum("draws").alias("drawn"))
    state = sources.where("slots > 0").join(got, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    state = state.withColumn("_over", F.greatest(F.lit(0), F.col("drawn") - F.col("slots"))).withColumn(
        "_under", F.greatest(F.lit(0), F.col("slots") - F.col("drawn")))
    state = written(numbered(state, ["source_no"], "_row", {"_over_upto": F.col("_over"), "_under_upto": F.col("_under")}).drop("_row"), "state")

    placed = _before(drawn.withColumn("_together", F.expr(f"shard div {SHARDS_TOGETHER}")), "draws", "_first", ["source_no"], "_together", ["shard"])
    rows = placed.join(state.select("source_no", "slots", "drawn", (F.col("_over_upto") - F.col("_over")).alias("_over_first")), "source_no")
    rows = rows.select("shard", "source_no", "slots", "drawn", "_over_first", F.explode(
        F.expr("sequence(_first, _first + draws - 1)")).alias("turn")).withColumn("index", F.col("turn"))
    mapped = written(shuffled(rows, "index", "drawn", "source_no", seed=seed).drop("drawn"), "mapped")
    kept = mapped.where("index < slots").select("shard", "turn", "source_no", "index")
    # What is over goes on to the sources that are under: the n-th index too many takes the n-th index missing.
    spare = mapped.where("index >= slots").select("shard", "turn", (F.col("_over_first") + F.col("index") - F.col("slots")).alias("_n"))
    missing = state.where("_under > 0").select("source_no", "drawn", (F.col("_under_upto") - F.col("_under")).alias("_from"), "_under").select(
        "source_no", "drawn", "_from", F.explode(F.expr("sequence(_from, _from + _under - 1)")).alias("_n"))
    moved = spare.join(missing, "_n").select("shard", "turn", "source_no", (F.col("drawn") + F.col("_n") - F.col("_from")).alias("index"))

    named = kept.union(moved).join(sources.select("source_no", "source_size", "words", "blocks"), "source_no")
    number = F.expr("index % blocks")
    left = F.col("words") - F.expr("index div blocks") * F.col("source_size") - number * block
    size = F.least(F.lit(block), F.col("source_size") - number * block, left)
    order = F.xxhash64(F.lit(seed), "shard", "source_no", "index")
    return named.select("shard", order.alias("turn"), "source_no", number.alias("block"), size.alias("words"))


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 512, seed: int = 42) -> Mix:
    """Mix all rows of `df` (doc_id, text, source).

    Sources weigh `weights`, repeating, in order of their code points (null is a source and comes last), and share `share` times all
    words; no source is taken more than `most` times. Null and empty texts have no words and give none. Rows that repeat a doc_id are
    documents of their own; rows that repeat all three columns take each other's place. Other columns are not looked at. An
    empty table, or one without words, gives an empty mix.
    """
    sized = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
    sized = written(sized, "sized")
    sources = written(_sources(sized, weights, share, most, block), "sources")
    found = sources.agg(F.sum("slots").alias("slots")).first()
    chunks = max(1, math.ceil(sized.count() / CHUNK_ROWS))

    dealt = sized.withColumn("chunk", F.pmod("mark", F.lit(chunks)))
    whole = dealt.groupBy("source", "chunk").agg(F.sum("size").alias("_words"))
    held = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    whole = whole.join(held, F.col("source").eqNullSafe(F.col("_source")))
    whole = _before(whole.withColumn("_together", F.expr(f"chunk div {SHARDS_TOGETHER}")), "_words", "_first", ["source_no"], "_together", ["chunk"])
    place = whole.select("_source", F.col("chunk").alias("_chunk"), "source_no", "source_size", "target", "_first")
    here = Window.partitionBy("source", "chunk").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    documents = (dealt.withColumn("_inside", F.coalesce(F.sum("size").over(here), F.lit(0)))
                 .join(place, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
                 .select("doc_id", "size", "source_no", "source_size", "target", (F.col("_first") + F.col("_inside")).alias("start")))
    return Mix(sources, written(documents, "placed"), _slots(sources, found["slots"] or 0, block, seed), block)


def pieces(made: Mix) -> DataFrame:
    """The blocks' contents: columns of `documents`, `block`, and the words [first, last) of the block that the document holds."""
    size = made.block
    spread = made.documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {size}, (start + size - 1) div {size})")))
    begin = F.col("block") * size
    return spread.withColumn("first", F.greatest(F.lit(0), F.col("start") - begin)).withColumn(
        "last", F.least(F.lit(size), F.col("start") + F.col("size") - begin))


def mixed(made: Mix) -> DataFrame:
    """(shard, turn, first, doc_id, from_word, to_word): the mix itself, block by block, joined by index. `turn` and then `first` is the order
    within a shard."""
    used = F.least("last", "words")
    held = pieces(made).join(made.slots, ["source_no", "block"]).where("first < words")
    begin = F.col("block") * made.block - F.col("start")
    return held.select("shard", "turn", "first", "doc_id", (begin + F.col("first")).alias("from_word"), (begin + used).alias("to_word"))


def taken(made: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix holds, repeats counted."""
    times = made.slots.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"))
    words = F.greatest(F.lit(0), F.least("last", "words") - F.col("first")) * F.col("times")
    columns = ["doc_id", "size", "source_size", "target"]
    given = (pieces(made).join(times, ["source_no", "block"], "left")
             .groupBy(*columns, "source_no", "start").agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken")))
    empty = made.documents.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    return given.select(*columns, "taken").union(empty)


"""Cleaning a corpus in four stages. Each reads what the one before kept, and its decisions take effect.

1. toxicity: documents that the class-conditional models reject go; the models are learnt from the labels.
2. simhash: of each group of documents with near fingerprints the one with the smallest doc_id stays.
3. suffixes: every byte under a string of 100 bytes that also starts earlier goes, and bytes of characters that were cut through with it. All
   rows stay.
4. packing: the texts become sequences of at most 4096 tokens, one row per piece.

All stages but the last return the columns of documents. Null texts count as empty. Rows without doc_id are never dropped as copies of others
and come last where order decides; rows that repeat a doc_id are told apart by their text. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import packing, simhash, suffixes, toxicity
from stockroom.llm.common import written

WORDS_PER_SHINGLE, MAX_BITS = 4, 4
SPAN = 100
CAPACITY = 4096


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.scores(docs, toxicity.fit(docs.select("doc_id", "text"), labels)).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints: the smallest doc_id, and of rows that repeat it one text."""
    return simhash.keep_one(docs, WORDS_PER_SHINGLE, MAX_BITS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that start earlier."""
    return suffixes.cleaned(docs, SPAN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: No stage can be expressed in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs

"""The registered queries of the text operators (thin: each gets its rows through its operator) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockroom.llm import lines, minhash, mixing, negatives, ngrams, packing, pages, phrases, pieces, simhash, suffixes, toxicity, vectors
from stockroom.llm.common import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return pieces.round_trip_digests(read(spark, sf_dir, "documents", "doc_id", "text"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learnt from four fifths of them."""
    return ngrams.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop every line, and every sentence of eight words or more, that comes up earlier."""
    return lines.line_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with models learnt from the labels."""
    return toxicity.toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte under a string of 100 bytes that also starts earlier."""
    return suffixes.repeat_digests(read(spark, sf_dir, "documents", "doc_id", "text"), span=100)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return minhash.edited_likeness(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of near ones."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), words_per_shingle=4, max_bits=4)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine 0.93 or more within their label."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.93)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words belong together most."""
    return phrases.collocations(read(spark, sf_dir, "documents", "lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label moved on."""
    vecs = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return negatives.hard_negatives(vecs, F.expr("vec_id % 100 = 0"), F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all words takes from each document."""
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash": op7_minhash,
    "op8_simhash": op8_simhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents),
lines AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS line FROM cut),
placed AS (SELECT *, sum(len(unit) + 1) OVER (PARTITION BY doc_id ORDER BY line) - len(unit) - 1 AS line_start FROM lines),
parts AS (
  SELECT doc_id, line, line_start, string_split(regexp_replace(unit, '([.!?] )', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM placed),
sentences AS (SELECT doc_id, line, line_start, unnest(parts) AS unit, generate_subscripts(parts, 1) AS sentence FROM parts),
all_units AS (
  SELECT doc_id, line, 0 AS sentence, unit, line_start AS place FROM placed
  UNION ALL
  SELECT doc_id, line, sentence, unit, line_start + sum(len(unit)) OVER (PARTITION BY doc_id, line ORDER BY sentence) - len(unit) FROM sentences),
named AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS words FROM all_units),
counted AS (SELECT *, CASE WHEN words = '' THEN 0 ELSE len(words) - len(replace(words, ' ', '')) + 1 END AS n_words FROM named),
judged AS (
  SELECT *, n_words >= CASE sentence WHEN 0 THEN 1 ELSE 8 END AS counts FROM counted),
ranked AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY sentence = 0, words ORDER BY doc_id, line, sentence) > 1 AS repeats FROM judged),
known AS (SELECT *, max(repeats AND sentence = 0) OVER (PARTITION BY doc_id, line) AS line_gone FROM ranked),
gone AS (SELECT *, repeats AND (sentence = 0 OR NOT line_gone) AS gone FROM known),
kept AS (
  SELECT doc_id, line, string_agg(unit, '' ORDER BY sentence) FILTER (NOT repeats) AS left_over FROM gone WHERE sentence > 0 AND NOT line_gone GROUP BY 1, 2),
texts AS (SELECT doc_id, string_agg(coalesce(left_over, ''), chr(10) ORDER BY line) AS kept_text FROM kept GROUP BY 1)
SELECT g.doc_id, CAST(count(*) FILTER (counts) AS BIGINT) AS n_units, count(*) FILTER (gone) AS n_removed,
  CAST(coalesce(sum(n_words) FILTER (gone), 0) AS BIGINT) AS removed_words, CAST(coalesce(sum(len(unit)) FILTER (gone), 0) AS BIGINT) AS removed_chars,
  coalesce(string_agg(CAST(place AS BIGINT) || ':' || CAST(place + len(unit) AS BIGINT), ',' ORDER BY place) FILTER (gone), '') AS removed_spans,
  coalesce(any_value(kept_text), '') AS kept_text
FROM gone g LEFT JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id""",
    "op10_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN named ON node = vec_id""",
    "op11_phrase_mining": r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10)) AS pieces
  FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS words FROM cut),
places AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS b FROM pieces WHERE len(words) > 0),
grams AS (
  SELECT lang, size, array_to_string(words[b:b + size - 1], ' ') AS phrase, count(*) AS total
  FROM places, generate_series(1, 5) AS g(size) WHERE b + size - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(total) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
good AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE total >= 100),
inner_ones AS (
  SELECT lang, array_to_string(w[1:size - 1], ' ') AS phrase, total FROM good WHERE size > 2
  UNION SELECT lang, array_to_string(w[2:size], ' '), total FROM good WHERE size > 2),
cuts AS (SELECT lang, phrase, size, total AS a, w, unnest(generate_series(1, size - 1)) AS k FROM good g
  WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = g.lang AND i.phrase = g.phrase AND i.total = g.total)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.total AS l, y.total AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.total AS HUGEINT) * y.total) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN good x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN good y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k AS cut
FROM lowest QUALIFY rank <= 2000""",
    "op12_hard_negatives": """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10""",
}

"""Queries p6 to p8 over documents, eval_items and common_words, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from anchorspan.llm import bpe, leaks, quality
from anchorspan.llm.holdout import HOLDOUT

#: Where the public vocabulary files lie.
TOKENIZERS = os.environ.get("ANCHORSPAN_TOKENIZERS", "/opt/tokenizers")
WINDOW, ERRORS = 13, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of 13 words of an item within one word edit, the least distance and its place."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=WINDOW, errors=ERRORS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 13 consecutive words with an item: the verified hits at distance 0."""
    return p7_leaks(spark, sf_dir).where("distance = 0").select("doc_id", "item_id").distinct()


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation and of common words."""
    return quality.document_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every non-blank text with its calibrated probability."""
    docs = table(spark, sf_dir, "documents")
    common = frozenset(quality.common_set(table(spark, sf_dir, "common_words")))
    return quality.classify(docs, quality.fit_model(docs, common, HOLDOUT))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not mainly natural prose, with their kind."""
    return p8_kinds(spark, sf_dir).where("text_kind <> 'prose'").select("doc_id", "text_kind")


QUERIES = {f.__name__: f for f in (p6_ids, p7_leaks, p7_found, p8_stats, p8_kinds, p8_found)}

#: p6_ids has no SQL; it is tested against a public tokenizer library and a round trip. p7_leaks is tested against brute
#: force, p8_kinds and p8_found by their accuracy on held-out texts.
SQL = {
    "p7_found": r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
wi AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM it)),
wd AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM wd JOIN wi USING (k)
""",
    "p8_stats": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w, regexp_replace(text, '[\s\x0b\x{85}\p{Z}]', '', 'g') AS v,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x0b\x{85}\p{Z}]')) AS l FROM documents),
c AS (SELECT DISTINCT lower(word) AS word FROM common_words),
a AS (SELECT list(word) AS words FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
CASE WHEN length(v) > 0 THEN round(length(regexp_replace(v, '[\p{L}\p{N}]', '', 'g')) / length(v), 6) END AS symbol_ratio,
CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;,"”»][\s\x0b\x{85}\p{Z}]*$'))) / len(l), 6) END AS end_punct_share,
CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(words, x))) / len(w), 6) END AS common_share
FROM d, a
""",
}

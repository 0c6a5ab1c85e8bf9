"""Corpus pipeline over ``documents``: stages, each an operator, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, jaccard, langid, mixing, substrings
from sightline.llm.common import materialize, read_table

#: Columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Lowest score that a language needs; a document below it, or without a letter, is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``lang`` stays what it was."""
    told = langid.predict(docs, langid.fit(docs))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a Jaccard similarity of 0.8 with those of no earlier document that stays: by Golay keys of SimHashes, and by prefixes what these can't reach."""
    return jaccard.drop_similar(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its words in repeated windows; ``n_chars`` follows the text. Ids may be null or repeated."""
    kept = substrings.remove_repeats(docs, hashes=True).select(F.col("doc_id").alias("_id"), "text_hash", "kept_text", "n_removed")
    changed = kept.where("n_removed > 0").dropDuplicates(["_id", "text_hash"])
    joined = docs.join(changed, docs["doc_id"].eqNullSafe(changed["_id"]) & (F.xxhash64(docs["text"]) == changed["text_hash"]), "left")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(mixing.mix(docs)).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, and digests of them and of the text they decode to."""
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, codec)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: None: the stages learn, hash and tokenise in ways SQL has no functions for; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage having worked on what the one before it wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

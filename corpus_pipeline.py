"""From raw documents to token ids: the stages, in order, over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one works on what it returned, written
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsewell.llm import bpe, decontaminate, quality, simhash, substring_dedup
from rinsewell.llm.tables import files_for, keep, read

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose perplexity is above the threshold of their language."""
    kept = quality.classify(docs, read(spark, sf_dir, "labels")).where("keep")
    return kept.select(*COLUMNS).coalesce(files_for(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id."""
    return simhash.one_of_each(docs, max_distance=4, shingle=4).select(*COLUMNS).coalesce(files_for(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of passages of 35 words or more that occur elsewhere; other texts stay as they are."""
    cut = substring_dedup.remove_repeated(docs, min_words=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cut = cut.select("doc_id", text.alias("text"), "lang", "source", "n_removed", "n_chars")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS).coalesce(files_for(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a copy, exact or edited, of a benchmark item."""
    clean = decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))
    return clean.select(*COLUMNS).coalesce(files_for(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (packed, unsigned 32-bit, little-endian), the number of ids, and
    whether the ids decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    decoded = bpe.encode(docs.select(*COLUMNS).coalesce(files_for(docs)), ranks, public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select(*COLUMNS, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]

#: The stages are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

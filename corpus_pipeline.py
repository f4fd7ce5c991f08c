"""A training corpus in five stages, each an operator of tradeloom.llm over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Nulls are empty texts throughout; empty tables stay empty; further
columns of docs pass through, whatever their names. Between its steps a stage writes keys and verdicts and frees them
when they are no longer read; run() frees each stage's documents when the next stage's are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import bpe, mixing, near_copies, quality, suffix_dedup
from tradeloom.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' verdict keeps."""
    return quality.kept(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.deduplicated(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of 200 bytes; n_chars follows."""
    return suffix_dedup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document comes once for each time it is drawn."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that the mix drew, in the order drawn."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"))


STAGES = [("quality rules", quality_stage), ("near copies", near_copies_stage), ("repeated strings", repeats_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]
#: Nearly every stage hashes or fits in ways that SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(key := "stage-" + name.replace(" ", "-"), stage(spark, docs, sf_dir))
        scratch.keep(key)
    return docs

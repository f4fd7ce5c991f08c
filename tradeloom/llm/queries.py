"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fill_middle, mixing, ngram_lm, preference, quality, simhash, suffix_dedup, token_counts, token_store, toxicity, turn_repair, vp_search
from .common import fold, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.op3(table(spark, sf_dir, "embeddings"), save=lambda df: written(df, "vectors"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.op4(table(spark, sf_dir, "conversations"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_store.op5(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, "<|endoftext|>", 50256)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.op6(table(spark, sf_dir, "documents"), fold("doc_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op8(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.op11(table(spark, sf_dir, "conversations"), save=lambda df: written(df, "decisions"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op12(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op13(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_bpe, op3_vantage_search, op4_preference_format, op5_token_store, op6_kneser_ney, op7_simhash, op8_suffix_dedup, op9_quality_rules, op10_mixing, op11_turn_repair, op12_fill_in_middle, op13_token_counts, pipeline)
}
ORACLES = {"op4_preference_format": preference.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE}

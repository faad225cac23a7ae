"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import encode_tokens
    from .tokens import tokenizer_path

    return encode_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import tokenizer_path

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [op1_token_files, op2_license_scan, op3_substrings, op4_packing, op5_neighbours, op6_toxicity, op7_secret_scan, op8_decontaminate, op9_language, op10_jaccard_join, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql():
    from . import oracles

    return oracles.oracle_sql()

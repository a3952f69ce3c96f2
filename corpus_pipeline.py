"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and token output, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import decontaminate, language_id, mixing, near_dedup, token_files
from geolith.llm.common import discard, made, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model fitted on them knows; those it rejects go: null texts, texts without a letter, and those far from every language.

    Null ids, sources and languages are kept, repeated rows stay, an empty table stays empty.
    """
    return language_id.known_language(docs, language_id.fit(docs, language_id.learnable(F.col("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more; the one with the smallest id.

    Texts without words and rows without an id stay; rows with one id are one document.
    """
    return near_dedup.one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in; null texts stay, null items have no window."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents that give each source the same share, in a global random order; a null source is one of its own."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token store of the documents, a row per copy; a null text is the end id alone, null ids come first."""
    return token_files.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixed), ("token files", tokens)]
#: The stages aren't expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = made()
    for _, stage in STAGES:
        folder = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage")
        docs = spark.read.parquet(f"{folder}/stage")
        discard(spark, keep=[*others, folder])  # what the stage used, and the result before
    return docs

"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import decontaminate, html_extract, language_id, media, mixing, near_dedup, substring_dedup, token_counts, token_files, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as a token store in id order, read back: start, number and crc32 of each one's ids."""
    return token_files.token_output(_read(spark, sf_dir, "documents"), _tokenizer())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words inside windows of ten words of benchmark items, and the items."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document, by whole tokens where they are proven."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the windows of 50 words that start in one with a smaller id, as a digest."""
    df = substring_dedup.dedup(_read(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as transport streams with their timestamps and random-access points, read back as digests."""
    return media.media_column(_read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents that give each source the same share, in a global random order."""
    return mixing.mix(_read(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by the nearest centroid, learned from the folds but number 2."""
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, language_id.learnable(F.col("doc_id"))))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page by a minimum cut."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are at least 0.8 alike."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived with each payload once, rebuilt by joins and read back."""
    return warc.archive(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_decontaminate, op3_token_counts, op4_substring_dedup, op5_media, op6_mix_sources, op7_language_id, op8_html_extract, op9_near_dedup, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op4_substring_dedup": substring_dedup.SQL, "op6_mix_sources": mixing.SQL, "op9_near_dedup": near_dedup.SQL, "op10_warc": warc.SQL}

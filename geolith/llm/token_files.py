"""Token-ID / binary output (1): Parquet files of token ids in ascending key order.

Layout of a token store, a folder of Parquet files:
  doc_id, shard, local_start, n_tokens  metadata, delta encoded, a few bytes a document
  tokens  list<int32>: the ids, delta encoded (DELTA_BINARY_PACKED), no dictionary
Files are written with version 2 pages, row groups of a set size and page indexes, so a reader
of metadata never touches token pages, and a key range reads only its pages. File number and
shard are the range partition: ascending shard, then row order, is ascending key order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.bpe import PIECE, encoder
from geolith.llm.common import give_back, partitions, shared_dir, text_column
from geolith.llm.words import pieces

STORE = "doc_id long, shard int, local_start long, n_tokens long, tokens array<int>"
RESULT = "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"


def options(row_group_mb: int = 32, page_kb: int = 256) -> dict[str, str]:
    """Parquet writer options of a token store."""
    return {
        "compression": "uncompressed",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "2000",
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, row_group_mb: int = 32, page_kb: int = 256, key: str = "doc_id", text: str = "text") -> None:
    """Encode each whole text, append end_id, and write a token store to path.

    Null counts as the empty text (its ids are end_id alone). Keys that are null come first;
    equal keys stay in the order of the input, and a key with very many rows is spread over several
    shards, as the range partitioning also goes by the row's place in the input. Empty
    tables give a store without rows. Other columns of docs are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i, part in pieces(batch.column(1), PIECE, max(1, batch.num_rows)):
                ids, n = enc.encode_all(part, end)
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, ids]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), tokens], ["doc_id", "shard", "local_start", "n_tokens", "tokens"])
                start += int(ends[-1])
        give_back()

    rows = text_column(docs, key, text).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions(docs.sparkSession), key, "place").sortWithinPartitions(key, "place")
    rows.select(key, text).mapInArrow(encode, STORE).write.options(**options(row_group_mb, page_kb)).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True) -> DataFrame:
    """The store's rows, or those with keys from first to last; without tokens only metadata pages are read."""
    df = spark.read.schema(STORE).parquet(path)
    df = df if first is None else df.where(F.col("doc_id") >= first)
    df = df if last is None else df.where(F.col("doc_id") <= last)
    return df if tokens else df.drop("tokens")


def bases(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids in all shards before. A row per file written, so its size is that of the partitioning."""
    totals = sorted((r.shard, r.n) for r in read_tokens(spark, path, tokens=False).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([n for _, n in totals]).tolist()
    return spark.createDataFrame([(s, e - n) for (s, n), e in zip(totals, ends)], "shard int, base long")


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the stored ids as little-endian unsigned 32-bit integers)."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(4)
            values, ends = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<u4"), col.offsets.to_numpy()
            n = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(n, pa.int64())], ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])
        give_back()

    rows = read_tokens(spark, path).mapInArrow(crc, RESULT)
    base = F.broadcast(bases(spark, path))  # a row per shard
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write docs as a token store in the shared folder and return digest_tokens of it."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, path, tokenizer, end_id)
    return digest_tokens(docs.sparkSession, path)

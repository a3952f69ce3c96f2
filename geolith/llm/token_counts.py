"""Token counts (3) by the whole-token shortcut.

Which vocabulary strings are one pre-token and encode alone as one token is proven once, on the
driver, by encoding the vocabulary (bpe.Encoder.whole_tokens), and sent to the workers. Such pre-tokens count
one each; only the rest is merged, each distinct word once while it stays in the worker's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.bpe import PIECE, encoder
from geolith.llm.common import text_column
from geolith.llm.words import pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): a row per row of docs.

    Null counts as the empty text: 0 bytes and tokens. A null key stays null, repeated rows stay
    repeated, an empty table gives none, other columns of docs are not read. Texts of any length are
    counted whole, one by one.
    """

    shared = docs.sparkSession.sparkContext.broadcast(encoder(tokenizer).whole_tokens())  # strings of the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        enc.counter(shared.value)
        for batch in batches:
            for start, part in pieces(batch.column(1), PIECE, batch.num_rows):
                n_bytes = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                n = pa.array(enc.count_all(part), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_column(docs, key, text).mapInArrow(count, SCHEMA)


def length_histogram(counts: DataFrame, width: int = 256) -> DataFrame:
    """bucket (its first n_tokens), n_docs, n_tokens: how many documents have how many tokens."""
    return counts.groupBy((F.floor(F.col("n_tokens") / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

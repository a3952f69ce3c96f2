"""Streams of documents: each is resolved on its own, so micro-batches need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from geolith.plans.geoparse import Geoparser
from geolith.sources import scratch


def resolve_stream(docs: DataFrame, parser: Geoparser, out: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Write each micro-batch's resolved places under out/batch=N. A batch that is run again overwrites its own folder only, so results come once."""

    def write(batch: DataFrame, number: int) -> None:
        before = scratch.made()
        try:
            parser.resolved(batch, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            scratch.discard(batch.sparkSession, before)  # a batch leaves nothing behind

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

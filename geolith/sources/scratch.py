"""Tables that cut a plan's lineage: written once, read from then on, and deleted when the results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only a local session without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="geolith-")
        _local[spark.sparkContext.applicationId] = base
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read from there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    return [*_made]


def discard(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Delete the folders made so far, but for those to keep. Results that were not written yet can't be read after it."""
    for path in set(_made) - set(keep or ()):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)

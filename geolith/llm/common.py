"""What the operators of this subpackage share: scratch tables, batches, words and crc32."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (as in tests) gets a temporary folder: executors of a cluster don't share one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="geolith-")
        _own[spark.sparkContext.applicationId] = base
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


_own: dict[str, str | None] = {}
_made: list[str] = []


def made() -> list[str]:
    """The folders that shared_dir gave this process so far and that are there still."""
    return [*_made]


def discard(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Delete the folders that shared_dir gave this process, but for those to keep. Results that were not written yet can't be read after it."""
    for path in set(_made) - set(keep):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read from there: its lineage is cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key from which it is hot, and keys that are hot at most: one of so many more has less than its share of the rows.
HOT, HOT_KEYS, SALTS = 1000, 100_000, 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """key: the values of more than max(HOT, rows / HOT_KEYS) rows each, so fewer than HOT_KEYS by their very count; None without any.

    Counts are summed in part before they are moved.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("hot_n"))
    found = stored(counts.where(F.col("hot_n") > HOT), "hot")
    if found.isEmpty():
        return None
    limit = max(HOT, rows.count() // HOT_KEYS)
    return found.where(F.col("hot_n") > limit).select(key)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """left joined with right on key, by merging; rows of left with a hot key are dealt to SALTS tasks a key by a hash of column `by`, and right's rows of it go to each.

    So a key that a third of left's rows share is no one task's. Meant for a right side with few rows a key. Only hot keys are broadcast, at most HOT_KEYS.
    """
    if hot is None:
        return left.join(right.hint("merge"), key, how)
    marks = F.broadcast(hot.select(F.col(key).alias("hot_key"), F.lit(True).alias("is_hot")))
    mark = lambda df: df.join(marks, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    salted = mark(left).withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = mark(right).withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("is_hot").join(copies.drop("is_hot").hint("merge"), [key, "salt"], how).drop("salt")


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on, and the next stage needs room too."""
    pa.default_memory_pool().release_unused()
    if trim := sys.platform == "linux" and getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(sizes: Iterable[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about limit; a larger single item is a range of its own."""
    start = total = i = 0
    for i, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, i
            start, total = i, 0
    if start < i:
        yield start, i


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def text_column(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under their own names; others can't clash with its results."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), *more)

"""Sinks: gazetteer upserts, event CSV, stored tables, weights, JSON."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_id(df: DataFrame, order: str, key: str = "geonameid") -> DataFrame:
    """One row per id, the last by order: what an index holds after writing all rows under their ids."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in columns))


def upsert(table: DataFrame, new: DataFrame, key: str = "geonameid") -> DataFrame:
    """table with new rows in the place of those with their ids."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def write_gazetteer(df: DataFrame, path: str) -> None:
    """Partitioned by country, so a known country reads its own files."""
    df.repartition("country_code3").write.mode("overwrite").partitionBy("country_code3").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, **partition: object) -> None:
    """df under fixed partition values, such as source, max_results or fuzzy."""
    for k, v in partition.items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("append").partitionBy(*partition).parquet(path)


def replace_table(df: DataFrame, path: str, **partition: object) -> None:
    """df in the place of what is stored under fixed partition values; other partitions stay."""
    folder = "/".join(f"{k}={v}" for k, v in partition.items())
    df.write.mode("overwrite").parquet(f"{path}/{folder}")


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def save_weights(weights: dict[str, np.ndarray], path: str) -> None:
    np.savez(path, **weights)


def load_weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k] for k in f.files}

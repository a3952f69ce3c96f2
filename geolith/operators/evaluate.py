"""Evaluation: accuracy and distance of predictions, shares of missing answers, reports by dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.math import haversine_km

METRICS = ("exact_match", "correct_country", "correct_code", "correct_adm1", "avg_dist", "acc_at_161")


def predictions(scored: DataFrame, *keys: str) -> DataFrame:
    """A row per mention: gold and predicted candidate, and n, from candidates (slot, score, is_correct, gazetteer columns).

    predicted is the first slot of the largest score; gold the first right one, null without any.
    """
    place = F.struct("geonameid", "country_code3", "feature_code", "admin1_code", "lat", "lon", "slot")
    by = Window.partitionBy(*keys, "doc_id", "mention_id")
    rows = scored.withColumn("n", F.count("*").over(by))
    return rows.groupBy(*keys, "doc_id", "mention_id").agg(
        F.max("n").alias("n"), F.max_by(place, F.struct("score", -F.col("slot"))).alias("predicted"), F.min_by(place, F.when(F.col("is_correct"), F.col("slot"))).alias("gold"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """predictions with missing, credited, the four agreements and km; the last are null where the gold entry is missing."""
    last = F.col("predicted.slot") == F.col("n") - 1
    gone = F.col("gold").isNull() | ((F.col("gold.slot") == F.col("n") - 1) & last)
    same = lambda c: F.when(~F.col("missing"), (F.col(f"gold.{c}") == F.col(f"predicted.{c}")).cast("int"))
    km = haversine_km(F.col("gold.lat"), F.col("gold.lon"), F.col("predicted.lat"), F.col("predicted.lon"))
    rows = rows.withColumns({"missing": gone, "credited": gone & last})
    return rows.withColumns({"ok_country": same("country_code3"), "ok_code": same("feature_code"), "ok_adm1": same("admin1_code"), "ok_id": same("geonameid"), "km": F.when(~F.col("missing"), km)})


def median(rows: DataFrame, value: str, *keys: str, width: float = 1.0) -> DataFrame:
    """keys and median: the exact median of value, which is not negative, by keys (one row without any); a group of nulls has no row.

    Equal values are counted first. Bins of `width` tell in which one or two the middle lies, and only their
    values are put in order, so no task holds all values of a group.
    """
    by = Window.partitionBy(*keys)
    # NaN comes last, as in Spark's own order
    place = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.floor(F.col(value) / width).cast("double"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.first(place).alias("bin"))
    bins = counted.groupBy(*keys, "bin").agg(F.sum("n").alias("in_bin"))
    bins = bins.withColumns({"total": F.sum("in_bin").over(by), "before": F.sum("in_bin").over(by.orderBy("bin")) - F.col("in_bin")})
    bins = bins.withColumns({"low": F.floor((F.col("total") - 1) / 2), "high": F.ceil((F.col("total") - 1) / 2)})
    middle = bins.where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("in_bin") > F.col("low"))).drop("in_bin", "total")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "bin")]
    near = counted.alias("a").join(middle.alias("b"), same).select("a.*", "before", "low", "high")
    first = Window.partitionBy(*keys, "bin").orderBy("v")
    upto = near.withColumn("upto", F.col("before") + F.sum("n").over(first))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
    return upto.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))


def evaluate(scored: DataFrame, *keys: str) -> DataFrame:
    """A row per value of keys (one without any) with the metrics."""
    rows = marked(predictions(scored, *keys))
    middle = median(rows, "km", *keys).alias("m")
    means = rows.groupBy(*keys).agg(
        F.count("*").alias("mentions"), F.avg("ok_country").alias("correct_country"), F.avg("ok_code").alias("correct_code"), F.avg("ok_adm1").alias("correct_adm1"), F.avg("ok_id").alias("exact_match"),
        F.avg("km").alias("avg_dist"), F.avg((F.col("km") <= 161).cast("int")).alias("acc_at_161"),
        F.coalesce(F.try_divide(F.sum(F.col("credited").cast("int")), F.sum(F.col("missing").cast("int"))), F.lit(0.0)).alias("missing_correct"), F.avg(F.col("missing").cast("int")).alias("total_missing"),
    ).alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys] or F.lit(True)  # without keys both are one row
    at = means.columns.index("avg_dist") + 1
    columns = [F.col(f"a.{c}") for c in means.columns]
    return means.join(middle, same, "left").select(*columns[:at], F.col("median").alias("median_dist"), *columns[at:])


def macro_average(by_dataset: DataFrame) -> DataFrame:
    """Plain means of the datasets' metrics."""
    return by_dataset.agg(*(F.avg(m).alias(m) for m in METRICS))


def report(scored: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Exact match, country agreement and mentions by dataset and of all together, in one pass."""
    return marked(predictions(scored, dataset)).rollup(dataset).agg(F.avg("ok_id").alias("exact_match"), F.avg("ok_country").alias("correct_country"), F.count("*").alias("mentions"))


def missing_at(scored: DataFrame, cutoff: int, *keys: str) -> DataFrame:
    """The share of mentions without a right candidate in the first `cutoff` slots."""
    by = scored.groupBy(*keys, "doc_id", "mention_id").agg(F.max((F.col("is_correct") & (F.col("slot") < cutoff)).cast("int")).alias("hit"))
    return by.groupBy(*keys).agg((1 - F.avg("hit")).alias("missing_share"))


def percent_correct(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Agreement in whole percent."""
    return rows.agg(F.round(100 * F.avg((F.col(predicted) == F.col(label)).cast("int"))).alias("percent"))

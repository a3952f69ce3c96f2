"""Decisions: the best candidate of each mention, its city, and a document's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_MENTION = ("doc_id", "mention_id")


def resolve(scored: DataFrame, slots: int, top_n: int = 1, strict: bool = False) -> DataFrame:
    """scored rows (all slots of each mention, real = has a candidate) -> doc_id, mention_id, slot, score, rank, reason.

    A mention whose last slot has the largest score, or whose best real candidate is the last of its
    real ones (which stands for no entry), has no answer: a row with null slot and a reason. strict
    drops the mention in the second case. Otherwise the top_n real slots by score, of equal
    scores the earlier.
    """
    group = Window.partitionBy(*_MENTION)
    real = F.col("real")
    rows = scored.withColumns(
        {
            "rank": F.row_number().over(group.orderBy(real.desc(), F.col("score").desc(), "slot")), "_best": F.max("score").over(group), "_last": F.max(F.when(F.col("slot") == slots - 1, F.col("score"))).over(group),
            "_null": F.max(F.when(real, F.col("slot"))).over(group), "_top": F.max(F.when(real, F.struct("score", (-F.col("slot")).alias("s")))).over(group),
        }
    )
    rows = rows.withColumn("reason", F.when(F.col("_last") == F.col("_best"), "no answer").when(F.col("_top").isNull(), "no candidates").when(-F.col("_top.s") == F.col("_null"), "no entry").otherwise(""))
    bare = F.col("reason") != ""
    rows = rows.where(F.when(bare, (F.col("rank") == 1) & ((F.col("reason") == "no answer") | F.lit(not strict))).otherwise(real & (F.col("rank") <= top_n)))
    more = ["place"] if "place" in scored.columns else []
    return rows.select(*_MENTION, *(F.when(~bare, F.col(c)).alias(c) for c in ("slot", "score", *more)), "rank", "reason")


def resolve_arrays(scored: DataFrame, top_n: int = 1, strict: bool = False) -> DataFrame:
    """What resolve gives, from slots.scored: a mention's rows are made of its one array, without a shuffle."""
    first = F.get("real", F.lit(0))
    none = F.array_max(F.transform("real", lambda x: x.slot))  # the last real slot stands for no entry
    reason = F.when(F.col("last") == F.col("best"), "no answer").when(F.size("real") == 0, "no candidates").when(first.slot == none, "no entry").otherwise("")
    rows = scored.withColumn("reason", reason).withColumn("bare", F.col("reason") != "")
    if strict:
        rows = rows.where("reason <> 'no entry'")
    rows = rows.select(*_MENTION, "reason", "bare", F.posexplode_outer(F.when(F.col("bare"), F.slice("real", 1, 1)).otherwise(F.slice("real", 1, top_n))).alias("pos", "x"))
    return rows.select(*_MENTION, *(F.when(~F.col("bare"), F.col(f"x.{c}")).alias(c) for c in ("slot", "score", "place")), (F.coalesce("pos", F.lit(0)) + 1).alias("rank"), "reason")


def best_over(scored: DataFrame, least: float = 0.01, top_n: int = 1) -> DataFrame:
    """The batch job's rule: of the real slots (the one for no entry among them) with a score over `least`, the top_n."""
    w = Window.partitionBy(*_MENTION).orderBy(F.col("score").desc(), "slot")
    return scored.where(F.col("real") & (F.col("score") > least)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(*_MENTION, "slot", "score", "rank")


def with_city(places: DataFrame, gazetteer: DataFrame, hierarchy: DataFrame, strict: bool = False) -> DataFrame:
    """places with city_id and city_name.

    A section of a place (PPLX) or a spot (class S) has the populated place that it is a child of; a
    section without a parent is its own city (strict: with id and name swapped); another populated
    place is its own; all others have none. Parents that are no populated place, or are not in the gazetteer, count as none.
    """
    up = hierarchy.select(F.col("child_id").alias("geonameid"), "parent_id")
    parent = gazetteer.select(F.col("geonameid").alias("parent_id"), F.col("name").alias("parent_name"), F.col("feature_class").alias("parent_class"))
    rows = places.join(up, "geonameid", "left").join(parent, "parent_id", "left")
    section, spot = F.col("feature_code") == "PPLX", F.col("feature_class") == "S"
    inside = (section | spot) & F.col("parent_id").isNotNull()
    own = F.col("feature_code").contains("PPL") & ~spot & (~section | F.col("parent_id").isNull())
    swap = section & F.col("parent_id").isNull() & F.lit(strict)
    pick = lambda a, b: F.when(inside & (F.col("parent_class") == "P"), F.col(a)).when(inside, "").when(swap, F.col({"geonameid": "name", "name": "geonameid"}[b])).when(own, F.col(b)).otherwise("")
    return rows.withColumns({"city_id": F.coalesce(pick("parent_id", "geonameid"), F.lit("")), "city_name": F.coalesce(pick("parent_name", "name"), F.lit(""))}).drop("parent_id", "parent_name", "parent_class")


def documents_out(docs: DataFrame, resolved: DataFrame, event_text: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_text, event_location_raw, geolocated_ents (array, in order of the mentions); documents without mentions have an empty one."""
    fields = [c for c in resolved.columns if c not in ("doc_id",)]
    first = [c for c in ("mention_id", "rank") if c in fields]
    own = resolved.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*first, *(c for c in fields if c not in first)))).alias("geolocated_ents"))
    rows = docs.select("doc_id", F.col("text").alias("doc_text")).join(own, "doc_id", "left")
    rows = rows.join(event_text, "doc_id", "left") if event_text is not None else rows.withColumn("event_location_raw", F.lit(""))
    kind = dict(rows.dtypes)["geolocated_ents"]
    return rows.select("doc_id", "doc_text", F.coalesce("event_location_raw", F.lit("")).alias("event_location_raw"), F.coalesce("geolocated_ents", F.array().cast(kind)).alias("geolocated_ents"))


def extracted(resolved: DataFrame) -> DataFrame:
    """The batch job's eleven fields of each resolved mention, by document: mentions without an entry are left out."""
    own = resolved.where("geonameid IS NOT NULL")
    return own.select("doc_id", F.col("search_name").alias("extracted_name"), "name", "lat", "admin1_name", "admin2_name", "country_code3", "feature_code", "lon", "geonameid", "start_char", "end_char")


def trimmed(resolved: DataFrame, internal: bool = True) -> DataFrame:
    """resolved without the features that only the scorer needs."""
    return resolved.drop(*("adm1_parent_match", "country_parent_match", "alt_name_length", "alternativenames", "min_dist", "max_dist", "avg_dist", "ascii_dist", "adm1_count", "country_count", "alt_name_log")) if internal else resolved


def first_n(df: DataFrame, n: int) -> DataFrame:
    """n rows, or all for a negative n."""
    return df.limit(n) if n >= 0 else df



"""Features of candidates: name distances, parents, coherence within a document, packing into slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.math import array_mean, min_max, name_distances

#: Fixed: the order of the numbers that a scorer gets, as models are trained on it.
FEATURES = ("alt_name_log", "max_dist", "avg_dist", "min_dist", "ascii_dist", "adm1_count", "country_count", "adm1_parent_match", "country_parent_match")
#: Fixed: codes that stand for no entry and for the last slot, and padding's distances.
NULL_CODE, LAST_CODE, PADDING = 52, 53, 99.0
_MENTION = ("doc_id", "mention_id")


def name_features(rows: DataFrame, by: tuple[str, ...] = _MENTION) -> DataFrame:
    """min_dist, max_dist, avg_dist to name and alternates, ascii_dist, and alt_name_log of (search_name, gazetteer columns), normalised within the mention, or the name if that is all of `by`."""
    d = name_distances(F.col("search_name"), F.concat(F.array("name"), "alternativenames"))
    rows = rows.withColumn("dists", d)
    rows = rows.withColumns({"min_dist": F.array_min("dists").cast("double"), "max_dist": F.array_max("dists").cast("double"), "avg_dist": array_mean(F.transform("dists", lambda x: x.cast("double"))), "ascii_dist": F.levenshtein("search_name", "asciiname").cast("double"), "alt_name_log": F.ln(F.size("alternativenames") + 1)})
    w = Window.partitionBy(*by)
    return rows.withColumns({c: min_max(F.col(c), w) for c in ("min_dist", "max_dist", "avg_dist", "ascii_dist", "alt_name_log")}).drop("dists")


def parent_features(rows: DataFrame, strict: bool = False) -> DataFrame:
    """adm1_parent_match and country_parent_match: 1 as the parent, -1 not, 0 without one. strict compares divisions by name alone."""
    none = F.coalesce("parent_country", F.lit("")) == ""
    same = (F.col("admin1_name") == F.col("parent_adm1")) & (F.lit(True) if strict else F.col("country_code3") == F.col("parent_country"))
    adm1 = F.when(none | (F.coalesce("parent_adm1", F.lit("")) == ""), 0).when(same, 1).otherwise(-1)
    country = F.when(none, 0).when(F.col("country_code3") == F.col("parent_country"), 1).otherwise(-1)
    return rows.withColumns({"adm1_parent_match": adm1, "country_parent_match": country})


def coherence(rows: DataFrame, strict: bool = False) -> DataFrame:
    """adm1_count and country_count: the share of a document's mentions that have a candidate in the same division, and country.

    Candidates without a division name, and those that stand for none, count 0; strict counts both like
    any other value and compares divisions by name alone. Rows of nulls (with_mentions) count as mentions alone. All windows lie within a document, so one
    exchange by document serves them, and nothing is compared pair by pair.
    """
    real = F.col("geonameid").isNotNull() if strict else F.coalesce(F.col("geonameid") != "NULL", F.lit(False))
    division = ["admin1_name"] if strict else ["country_code3", "admin1_name"]
    share = lambda mask, *by: F.size(F.collect_set(F.when(mask, F.col("mention_id"))).over(Window.partitionBy("doc_id", *by))) / F.col("n_mentions")
    rows = rows.withColumn("n_mentions", F.size(F.collect_set("mention_id").over(Window.partitionBy("doc_id"))))
    named = real if strict else real & (F.col("admin1_name") != "")
    rows = rows.withColumns({"adm1_count": share(named, *division), "country_count": share(real, "country_code3")})
    return rows.withColumns({"adm1_count": F.when(named, F.col("adm1_count")).otherwise(0.0), "country_count": F.when(real, F.col("country_count")).otherwise(0.0)}).drop("n_mentions")


def with_mentions(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """rows, and a row of nulls for each mention without candidates, so a document's mentions can be counted."""
    return mentions.select(*_MENTION).join(rows, list(_MENTION), "left")


def with_null_candidate(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """rows and, behind each mention's candidates, one that stands for no entry; mentions without candidates have it alone."""
    fields = [("slot", "int"), *((c, t) for c, t in rows.dtypes if c not in (*_MENTION, "slot"))]
    value: dict[str, Column] = {}
    for c, kind in fields[1:]:
        if c in ("alt_name_log", "lat", "lon", "adm1_count", "country_count"):
            value[c] = F.lit(0.0)
        elif c.endswith("_dist"):
            value[c] = F.lit(PADDING)
        elif c.endswith("_parent_match"):
            value[c] = F.lit(-1)
        elif kind == "string":
            value[c] = F.lit("NULL" if c in ("geonameid", "name", "asciiname", "feature_class", "feature_code", "country_code3", "admin1_code", "admin1_name", "admin2_code", "admin2_name") else "")
        else:
            value[c] = F.lit(None)
    kind = f"array<struct<{', '.join(f'{c}: {t}' for c, t in fields)}>>"
    own = rows.groupBy(*_MENTION).agg(F.array_sort(F.collect_list(F.struct(*(c for c, _ in fields)))).cast(kind).alias("own"))
    every = mentions.select(*_MENTION).join(own, list(_MENTION), "left").withColumn("own", F.coalesce("own", F.array().cast(kind)))
    null = F.struct(F.size("own").alias("slot"), *(value[c].cast(t).alias(c) for c, t in fields[1:]))
    return every.select(*_MENTION, F.explode(F.concat("own", F.array(null).cast(kind))).alias("c")).select(*(F.col(c) if c in _MENTION else F.col(f"c.{c}").alias(c) for c in rows.columns))


def without_gold(rows: DataFrame, gold: str = "gold_id") -> DataFrame:
    """Candidates without the right ones: hard negatives."""
    return rows.where(~F.coalesce(F.col("geonameid") == F.col(gold), F.lit(False)))


def correct(rows: DataFrame, gold: str = "gold_id") -> DataFrame:
    return rows.withColumn("is_correct", F.coalesce(F.col("geonameid") == F.col(gold), F.lit(False)))


def coded(rows: DataFrame, feature_codes: DataFrame, countries: DataFrame) -> DataFrame:
    """rows with code_idx (unknown: as for no entry) and country_idx (unknown: as for NA). Both tables are small and fixed."""
    na = F.lit(countries.where("code3 = 'NA'").first().idx)
    rows = rows.join(feature_codes.select("feature_code", F.col("idx").alias("code_idx")), "feature_code", "left")
    rows = rows.join(countries.select(F.col("code3").alias("country_code3"), F.col("idx").alias("country_idx")), "country_code3", "left")
    return rows.withColumns({"code_idx": F.coalesce("code_idx", F.lit(NULL_CODE)), "country_idx": F.coalesce("country_idx", na)})


def packed(rows: DataFrame, slots: int, null_country: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, mention_id, slot, code_idx, country_idx, features, real, place: exactly `slots` rows of each mention.

    Candidates beyond are cut, missing ones are padding. The last slot has code 53 and features of -1,
    even if a candidate stands there. place has the columns to keep, null for padding.
    """
    pad = F.array(*(F.lit(0.0 if c.endswith(("_count", "_match")) else PADDING) for c in FEATURES))
    own = F.struct("slot", "code_idx", "country_idx", F.array(*(F.col(c).cast("double") for c in FEATURES)).alias("features"), F.struct(F.lit(True).alias("real"), *keep).alias("place"))
    by = rows.groupBy(*_MENTION).agg(F.map_from_entries(F.collect_list(F.struct("slot", own))).alias("own"))
    full = by.select(*_MENTION, "own", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).withColumn("own", F.try_element_at("own", F.col("slot")))
    last = F.col("slot") == slots - 1
    return full.select(
        *_MENTION, "slot", F.when(last, LAST_CODE).otherwise(F.coalesce("own.code_idx", F.lit(NULL_CODE))).alias("code_idx"), F.coalesce("own.country_idx", F.lit(null_country)).alias("country_idx"),
        F.when(last, F.array(*(F.lit(-1.0) for _ in FEATURES))).otherwise(F.coalesce("own.features", pad)).alias("features"), F.col("own").isNotNull().alias("real"), F.col("own.place").alias("place"),
    )

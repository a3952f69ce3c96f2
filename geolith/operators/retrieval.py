"""Retrieval: gazetteer entries for names, by phrase, by fuzzy words, by id, and parents.

Phrase search is an equality join with the phrase index, never a test of each name against each
entry. Distinct names are searched once and fanned out to mentions afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.text import clean_search_name, normal
from geolith.operators.gazetteer import word_index


def restrict(gazetteer: DataFrame, known_country: str | None = None, limit_types: bool = False, feature_code: str | None = None) -> DataFrame:
    """The entries of a country, of populated places and areas, or of a feature code."""
    if known_country:
        gazetteer = gazetteer.where(F.col("country_code3") == known_country)
    if limit_types:
        gazetteer = gazetteer.where(F.col("feature_class").isin("P", "A"))
    if feature_code:
        gazetteer = gazetteer.where(F.col("feature_code") == feature_code)
    return gazetteer


def _top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """slot from 0 among each query's hits; partial limits run before the shuffle."""
    w = Window.partitionBy("query").orderBy(*order)
    return hits.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < k)


def phrase_search(names: DataFrame, index: DataFrame, gazetteer: DataFrame, k: int = 50, **only: object) -> DataFrame:
    """query, slot, geonameid: for each distinct query of names, the first k entries one of whose names has it as a run of words.

    The order is that of alt_name_length, downwards, then of geonameid. only: see restrict. Of a ranked index an
    unrestricted search reads the first k of each phrase.
    """
    wanted = names.select("query").distinct().withColumn("phrase", normal(F.col("query"))).where("phrase <> ''")
    if "rank" in index.columns and not any(only.values()):
        return wanted.join(index.where(F.col("rank") < k), "phrase").select("query", F.col("rank").alias("slot"), "geonameid")
    facts = restrict(gazetteer, **only).select("geonameid", "alt_name_length")
    hits = wanted.join(index, "phrase").join(facts, "geonameid").select("query", "geonameid", "alt_name_length")
    return _top(hits, k, F.col("alt_name_length").desc(), F.col("geonameid")).select("query", "slot", "geonameid")


def _deletions(word: Column, n: int) -> Column:
    """The word and all that is left of it after taking out up to n letters."""
    out = F.array(word)
    for _ in range(n):
        less = F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array(w))))
        out = F.array_distinct(F.concat(out, less))
    return out


def fuzzy_search(names: DataFrame, gazetteer: DataFrame, k: int = 50, edits: int = 1, **only: object) -> DataFrame:
    """query, slot, geonameid: the first k entries with a word within `edits` of a word of the query.

    Words that are within n edits share what is left of them after at most n deletions each, so
    the join is one of equality, checked by the distance itself.
    """
    wanted = names.select("query").distinct().select("query", F.explode(F.array_distinct(F.split(normal(F.col("query")), " "))).alias("q_word")).where("q_word <> ''")
    own = restrict(gazetteer, **only)
    words = word_index(own)
    left = wanted.select("query", "q_word", F.explode(_deletions(F.col("q_word"), edits)).alias("rest"))
    right = words.select("word").distinct().select("word", F.explode(_deletions(F.col("word"), edits)).alias("rest"))
    alike = left.join(right, "rest").where(F.levenshtein("q_word", "word", edits) >= 0).select("query", "word").distinct()
    hits = alike.join(words, "word").select("query", "geonameid").distinct().join(own.select("geonameid", "alt_name_length"), "geonameid")
    return _top(hits, k, F.col("alt_name_length").desc(), F.col("geonameid")).select("query", "slot", "geonameid")


def search(names: DataFrame, index: DataFrame, gazetteer: DataFrame, k: int = 50, fuzzy: int = 0, **only: object) -> DataFrame:
    """Phrase search (fuzzy search, if fuzzy is not 0); queries without a hit are searched again with one edit more."""
    first = fuzzy_search(names, gazetteer, k, fuzzy, **only) if fuzzy else phrase_search(names, index, gazetteer, k, **only)
    rest = names.select("query").distinct().join(first.select("query").distinct(), "query", "left_anti")
    return first.unionByName(fuzzy_search(rest, gazetteer, k, fuzzy + 1, **only))


def candidates(mentions: DataFrame, index: DataFrame, gazetteer: DataFrame, k: int = 50, fuzzy: int = 0, fallback: bool = True, strict: bool = False, every: bool = False, **only: object) -> DataFrame:
    """doc_id, mention_id, search_name, in_rel, slot, geonameid of each mention's candidates (with `every`, nulls for a mention without any); the name is cleaned for the search alone. strict: limit_types has no effect."""
    only = {**only, "limit_types": False} if strict else only
    named = mentions.select("doc_id", "mention_id", "search_name", "in_rel", clean_search_name(F.col("search_name"), strict).alias("query"))
    find = search if fallback else lambda n, i, g, k, fuzzy, **o: fuzzy_search(n, g, k, fuzzy, **o) if fuzzy else phrase_search(n, i, g, k, **o)
    return named.join(find(named, index, gazetteer, k, fuzzy, **only), "query", "left" if every else "inner").drop("query")


def best_by_phrase(names: DataFrame, index: DataFrame, gazetteer: DataFrame, feature_code: str, countries: bool = False) -> DataFrame:
    """query and the entry's columns: of the entries of a feature code with the phrase, the first by an exact name, alt_name_length and population (downwards), and geonameid.

    With countries, names has code3 too, and only entries of that country count.
    """
    keys = ["query", "code3"] if countries else ["query"]
    wanted = names.select(*keys).distinct().withColumn("phrase", normal(F.col("query"))).where("phrase <> ''")
    hits = wanted.join(index, "phrase").join(restrict(gazetteer, feature_code=feature_code), "geonameid")
    hits = hits.where(F.col("code3") == F.col("country_code3")) if countries else hits
    exact = F.exists(F.concat(F.array("name", "asciiname"), "alternativenames"), lambda n: normal(n) == F.col("phrase"))
    w = Window.partitionBy(*keys).orderBy(exact.desc(), F.col("alt_name_length").desc(), F.col("population").desc(), "geonameid")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank", "phrase")


def country_by_name(names: DataFrame, index: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return best_by_phrase(names, index, gazetteer, "PCLI")


def adm1_by_name(names: DataFrame, index: DataFrame, gazetteer: DataFrame, countries: bool = False) -> DataFrame:
    return best_by_phrase(names, index, gazetteer, "ADM1", countries)


def country_by_code(codes: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """code3 and the entry of that country, the first by geonameid."""
    own = restrict(gazetteer, feature_code="PCLI")
    w = Window.partitionBy("country_code3").orderBy("geonameid")
    return codes.join(own.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank"), F.col("code3") == F.col("country_code3"))


def by_id(ids: DataFrame, gazetteer: DataFrame, key: str = "geonameid") -> DataFrame:
    """ids with the entry's columns, null where there is none."""
    return ids.join(gazetteer if key == "geonameid" else gazetteer.withColumnRenamed("geonameid", key), key, "left")


def parents(mentions: DataFrame, index: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """in_rel, parent_country, parent_adm1: for each distinct parent text, the country of that name, else the first-level division."""
    names = mentions.where("in_rel <> ''").select(F.col("in_rel").alias("query")).distinct()
    country = country_by_name(names, index, gazetteer).select("query", F.struct("country_code3", F.lit("").alias("admin1_name")).alias("c"))
    adm1 = adm1_by_name(names, index, gazetteer).select("query", F.struct("country_code3", "admin1_name").alias("a"))
    own = names.join(country, "query", "left").join(adm1, "query", "left").withColumn("p", F.coalesce("c", "a"))
    return own.where("p IS NOT NULL").select(F.col("query").alias("in_rel"), F.col("p.country_code3").alias("parent_country"), F.col("p.admin1_name").alias("parent_adm1"))


def country_names(places: DataFrame, info: DataFrame, column: str = "country_code3") -> DataFrame:
    """places with country_name, the code itself where info (code3, name) lacks it."""
    return places.join(info.select(F.col("code3").alias(column), F.col("name").alias("country_name")), column, "left").withColumn("country_name", F.coalesce("country_name", F.col(column)))

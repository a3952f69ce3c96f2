"""Gazetteer: from a raw dump to the table that is searched, and its indexes."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from geolith.functions.text import expand_accents, phrases
from geolith.schemas import DataExtent

#: Fixed: further names of two entries.
ALIASES = {"6252001": ["US", "U.S."], "239880": ["C.A.R."]}


def iso_codes(country_info: DataFrame) -> DataFrame:
    """iso2, code3 from a country table."""
    return country_info.select(F.trim("ISO").alias("iso2"), F.trim("ISO3").alias("code3"))


def build_gazetteer(raw: DataFrame, iso: DataFrame, adm1: DataFrame, adm2: DataFrame, expand_ascii: bool = True, day: datetime.date = datetime.date(2024, 1, 1), counted: Observation | None = None) -> DataFrame:
    """GAZETTEER rows of a dump's valid rows.

    iso: iso2, code3; adm1 and adm2: code (CC.A1, CC.A1.A2), name. Unknown countries are NA, unknown
    divisions have an empty name. alt_name_length counts distinct alternates before accents are
    expanded; no alternates count as one, the empty name. counted gets rows, invalid and no_adm2.
    The lookups are as large as the world's divisions, so they are left to the optimizer to broadcast.
    """
    df = raw.join(iso, "iso2", "left")
    df = df.withColumns({"key1": F.concat_ws(".", "iso2", "admin1_code"), "key2": F.concat_ws(".", "iso2", "admin1_code", "admin2_code")})
    df = df.join(adm1.select(F.col("code").alias("key1"), F.col("name").alias("admin1")), "key1", "left")
    df = df.join(adm2.select(F.col("code").alias("key2"), F.col("name").alias("admin2")), "key2", "left")
    if counted is not None:
        df = df.observe(counted, F.count("*").alias("rows"), F.sum((~F.col("valid")).cast("long")).alias("invalid"), F.sum((F.col("valid") & F.col("admin2").isNull()).cast("long")).alias("no_adm2"))
    alternates = F.array_distinct(F.split(F.coalesce("alternates", F.lit("")), ","))
    for k, v in ALIASES.items():
        alternates = F.when(F.col("geonameid") == k, F.concat(F.array_distinct(F.split("alternates", ",")), F.array(*map(F.lit, v)))).otherwise(alternates)
    df = df.where("valid").withColumn("alts", alternates)
    return df.select(
        "geonameid", "name", "asciiname", (expand_accents(F.col("alts")) if expand_ascii else F.col("alts")).alias("alternativenames"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "feature_class", "feature_code", F.coalesce("code3", F.lit("NA")).alias("country_code3"),
        "admin1_code", F.coalesce("admin1", F.lit("")).alias("admin1_name"), "admin2_code", F.coalesce("admin2", F.lit("")).alias("admin2_name"), "admin3_code", "admin4_code",
        F.coalesce(F.col("population").try_cast("long"), F.lit(0)).cast("long").alias("population"), F.size("alts").alias("alt_name_length"), F.lit(day).alias("modification_date"),
    )


def all_names(gazetteer: DataFrame) -> DataFrame:
    """geonameid, place_name: a row per distinct name of an entry."""
    return gazetteer.select("geonameid", F.explode(F.array_distinct(F.concat(F.array("name", "asciiname"), "alternativenames"))).alias("place_name"))


def phrase_index(gazetteer: DataFrame) -> DataFrame:
    """phrase, geonameid: every run of words within one name, of any length, as searches have no other exact path. Written once, it serves all searches by equality."""
    return all_names(gazetteer).select("geonameid", F.explode(phrases(F.col("place_name"))).alias("phrase")).distinct()


def ranked_index(gazetteer: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """phrase, geonameid, rank: the phrase index with each entry's rank, from 0, among those of the phrase, by alt_name_length, downwards, and geonameid.

    So an unrestricted search for k entries reads ranks below k alone: it neither looks at the gazetteer nor sorts the hundreds of thousands of
    entries of a common word. Restricted searches take the phrase's other rows too.
    With wanted (phrase, distinct) only these phrases' rows are made, by a scan of the gazetteer that moves nothing else: for a job that no other
    follows. An id is one entry's.
    """
    if wanted is not None:
        own = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.concat(F.array("name", "asciiname"), "alternativenames")), phrases)))
        rows = gazetteer.select("geonameid", "alt_name_length", F.explode(own).alias("phrase")).join(wanted, "phrase")
    else:
        rows = phrase_index(gazetteer).join(gazetteer.select("geonameid", "alt_name_length"), "geonameid")
    order = Window.partitionBy("phrase").orderBy(F.col("alt_name_length").desc(), "geonameid")
    return rows.select("phrase", "geonameid", (F.row_number().over(order) - 1).alias("rank"))


def missing(tables: dict[str, DataFrame | None]) -> list[str]:
    """The names of tables that are not there or have no row: what a job should look at before it starts."""
    return [name for name, df in tables.items() if df is None or df.isEmpty()]


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether there is such a table in the catalog, or a stored table at that path."""
    if "/" in name:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.catalog.tableExists(name)


def word_index(gazetteer: DataFrame) -> DataFrame:
    """word, geonameid: for fuzzy search, each word of each name."""
    return all_names(gazetteer).select("geonameid", F.explode(phrases(F.col("place_name"), 1)).alias("word")).distinct()


def data_extent(gazetteer: DataFrame | None) -> DataExtent:
    """ALL if a city of the US and a province of the Netherlands are there, TEST with the latter only, else NONE; NA without a table."""
    if gazetteer is None:
        return DataExtent.NA
    here = gazetteer.where(F.col("feature_code").isin("ADM1", "PCLI") | (F.col("feature_class") == "A"))
    has = lambda name, code: not here.where((F.col("country_code3") == code) & ((F.col("name") == name) | (F.col("asciiname") == name) | F.array_contains("alternativenames", name))).isEmpty()
    usa, nld = has("New York", "USA"), has("North Holland", "NLD")
    return DataExtent.ALL if usa and nld else DataExtent.TEST if nld else DataExtent.NONE


def describe_extent(gazetteer: DataFrame | None) -> tuple[DataExtent, str]:
    extent = data_extent(gazetteer)
    return extent, {0: "no gazetteer", 1: "a gazetteer without the expected entries", 2: "a test gazetteer", 3: "a full gazetteer"}[extent]

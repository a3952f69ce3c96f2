"""Scans: gazetteer dumps, lookup tables, stories, coded events, annotated corpora, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith import schemas


def _no_nulls(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def _tsv(spark: SparkSession, path: str, schema: str, quote: str = '"') -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", quote=quote, escape=quote or None, multiLine=False)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer dump: 19 tab-separated columns; a row without an id, or with a coordinate that is no number, is not valid."""
    df = _no_nulls(_tsv(spark, path, schemas.RAW))
    return df.withColumn("valid", (F.col("geonameid") != "") & F.col("lat").try_cast("double").isNotNull() & F.col("lon").try_cast("double").isNotNull())


def read_admin(spark: SparkSession, path: str) -> DataFrame:
    """code, name of first- or second-level divisions; of repeated codes the last line's."""
    df = _no_nulls(_tsv(spark, path, schemas.ADMIN)).withColumn("place", F.monotonically_increasing_id())
    return df.groupBy("code").agg(F.max_by("name", "place").alias("name"))


def last_parents(rows: DataFrame, place: str = "place") -> DataFrame:
    """child_id, parent_id: the last line of each child; lines without both are skipped."""
    return rows.where("coalesce(child_id, '') <> '' AND parent_id IS NOT NULL").groupBy("child_id").agg(F.max_by("parent_id", place).alias("parent_id"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return last_parents(_tsv(spark, path, schemas.HIERARCHY).withColumn("place", F.monotonically_increasing_id()))


def read_country_info(spark: SparkSession, path: str) -> DataFrame:
    """The country table with a header line; NA is a country, not a missing value."""
    return _no_nulls(spark.read.csv(path, header=True, sep="\t", nullValue="\u0000"))


def read_country_codes(spark: SparkSession, path: str, column: str = "Alpha-3 code", more: tuple[str, ...] = ("CUW", "XKX", "SCG", "SSD", "BES", "SXM", "NULL", "NA")) -> DataFrame:
    """code3, idx: codes in the order of a CSV file, then those that it lacks (`more`; fixed: a model's country numbers rest on it)."""
    codes = [r[0] for r in spark.read.csv(path, header=True, nullValue="\u0000").select(F.trim(F.col(f"`{column}`"))).collect()]  # a row per country
    return spark.createDataFrame([(c, i) for i, c in enumerate([*codes, *more])], "code3 string, idx int")


def read_feature_codes(spark: SparkSession, path: str) -> DataFrame:
    """feature_code, idx from one JSON object of numbers."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("feature_code", "idx"))
    return one


def read_coded_events(spark: SparkSession, path: str) -> DataFrame:
    """Event-coded news, its columns named as in schemas.CODED_EVENT_COLUMNS, all strings."""
    return _no_nulls(_tsv(spark, path, schemas.CODED_EVENT))


def coded_events(rows: DataFrame) -> DataFrame:
    """storyid, event_id, Headline, Rawtext (the event's sentence), text (the same), name, sentence_num of event-coded news: what story_events gives for stories."""
    sentence = F.col("`Event Sentence`")
    return rows.select(
        F.col("`Story ID`").alias("storyid"), F.col("`Event ID`").alias("event_id"), "Headline", sentence.alias("Rawtext"), sentence.alias("text"), F.col("`Event Text`").alias("name"),
        F.col("`Sentence Number`").try_cast("int").alias("sentence_num"),
    )


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories with their events, one JSON object a line."""
    return spark.read.schema(schemas.STORY).json(path)


def story_events(stories: DataFrame) -> DataFrame:
    """A row per event, with its story's headline, text and id."""
    return stories.select("storyid", "Headline", "Rawtext", F.explode("events").alias("event")).select("storyid", "Headline", "Rawtext", "event.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """An annotated corpus: articles of an XML file, or rows of a JSONL file, by the path's ending."""
    if "xml" in path:
        return spark.read.format("xml").option("rowTag", "article").load(path)
    if "jsonl" in path:
        return spark.read.json(path)
    raise ValueError(f"neither xml nor jsonl: {path}")


def read_table(spark: SparkSession, path: str, **where: object) -> DataFrame:
    """A stored table (parsed documents, candidates), with only the wanted partitions."""
    df = spark.read.parquet(path)
    for k, v in where.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def input_kind(df: DataFrame) -> str:
    """text or tokens, whichever column documents come with."""
    for kind in ("tokens", "text"):
        if kind in df.columns:
            return kind
    raise ValueError("documents need a text or a tokens column")

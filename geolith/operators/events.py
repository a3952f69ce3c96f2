"""Events: where a reported event took place, from mentions and a question answerer's span."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.text import partial_text

#: (questions, contexts) -> rows of start, end, answer.
Answerer = Callable[[list[str], list[str]], list[tuple[int, int, str]]]
#: Fixed: the reasons, by case.
REASONS = {
    "none": "No locations found",
    "one_unique": "No location identified in event location model, but only one (unique) location in text",
    "many": "Multiple locations, but none identified as the event location",
    "one": "No location identified in event location model, but only one location in text",
    "match": "Match: single geo result overlapping with event location",
    "place": "Multiple locations are within the event location: picking the first non-admin unit",
    "no_place": "Multiple locations within event location. None are feature type places.",
}


def question(name: Column, verb: str = "Where did") -> Column:
    """The question about an event of that name."""
    return F.concat(F.lit(f"{verb} "), F.lower(name), F.lit(" happen?"))


def headline_text(headline: Column, sentence: Column, between: str = ". ") -> Column:
    return F.concat_ws(between, headline, sentence)


def event_documents(events: DataFrame) -> DataFrame:
    """events (storyid, Headline, Rawtext, event_id, text, name) with doc_text, partial_doc (to the last occurrence of the event's text; the whole, if there is none) and found."""
    df = events.withColumn("doc_text", headline_text(F.col("Headline"), F.col("Rawtext"), "\n"))
    cut = partial_text(F.col("doc_text"), F.col("text"))
    return df.withColumns({"found": cut.isNotNull(), "partial_doc": F.coalesce(cut, F.col("doc_text"))})


def answers(events: DataFrame, answerer: Answerer) -> DataFrame:
    """events with qa (start, end, answer) for name's question and partial_doc, in batches."""

    @F.pandas_udf("struct<start: int, end: int, answer: string>")
    def ask(questions: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(answerer(questions.tolist(), contexts.tolist()), columns=["start", "end", "answer"])

    return events.withColumn("qa", ask(question(F.col("name")), F.col("partial_doc")))


def mentions_before(events: DataFrame, limit: str = "partial_doc", geo: str = "geo") -> DataFrame:
    """events whose geo array keeps resolved mentions that start before the end of `limit`."""
    return events.withColumn(geo, F.filter(geo, lambda x: x.isNotNull() & x.geonameid.isNotNull() & (x.start_char < F.length(limit))))


def pick_event_location(events: DataFrame, strict: bool = False) -> DataFrame:
    """events (geo: array of places with start_char, name, feature_class, feature_code; qa) with event_loc and event_loc_reason.

    The place whose mention starts in the answer's span, both ends included; of several, the first
    populated place. Without one, the text's only place, by name. strict takes codes that begin with P for
    populated places, countries among them.
    """
    geo = F.filter(F.coalesce("geo", F.array().cast(dict(events.dtypes)["geo"])), lambda x: x.isNotNull())
    df = events.withColumn("_geo", geo).withColumn("_in", F.filter("_geo", lambda x: x.start_char.between(F.col("qa.start"), F.col("qa.end"))))
    df = df.withColumn("_places", F.filter("_in", lambda x: x.feature_code.startswith("P") if strict else x.feature_class == "P"))
    n, k = F.size("_geo"), F.size("_in")
    unique = F.size(F.array_distinct(F.transform("_geo", lambda x: x["name"]))) == 1
    case = (
        F.when(n == 0, "none").when((k == 0) & (n == 1), "one").when((k == 0) & unique, "one_unique").when(k == 0, "many")
        .when(k == 1, "match").when(F.size("_places") > 0, "place").otherwise("no_place")
    )
    df = df.withColumn("_case", case)
    loc = F.when(F.col("_case").isin("one", "one_unique"), F.get("_geo", F.lit(0))).when(F.col("_case") == "match", F.get("_in", F.lit(0))).when(F.col("_case") == "place", F.get("_places", F.lit(0)))
    reason = F.lit(None).cast("string")
    for k_, v in REASONS.items():
        reason = F.when(F.col("_case") == k_, v).otherwise(reason)
    return df.withColumns({"event_loc": loc, "event_loc_reason": reason}).drop("_geo", "_in", "_places", "_case")


def event_rows(events: DataFrame, info: DataFrame) -> DataFrame:
    """The job's output columns: the event, its place's names from district to country, coordinates, id and reason. info: code3, name."""
    loc = lambda c: F.col(f"event_loc.{c}")
    named = events.join(info.select(F.col("code3").alias("_code"), F.col("name").alias("_country")), loc("country_code3") == F.col("_code"), "left")
    return named.select(
        *(c for c in ("storyid", "event_id", "Headline", "text", "name", "sentence_num", "partial_doc") if c in events.columns), F.col("qa.answer").alias("qa_answer"),
        *([loc("search_name").alias("extracted_name")] if "search_name" in events.schema["event_loc"].dataType.names else []), loc("name").alias("place"), loc("admin2_name").alias("district"), loc("admin1_name").alias("province"),
        F.coalesce("_country", loc("country_code3")).alias("country"), loc("lat").alias("lat"), loc("lon").alias("lon"), loc("geonameid").alias("geonameid"), "event_loc_reason",
    )

"""The whole job: documents to resolved places, and reported events to their locations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.text import clean_search_name, normal
from geolith.operators import events as ev
from geolith.operators import features as ft
from geolith.operators import gazetteer as gz
from geolith.operators import mentions as mn
from geolith.operators import resolve as rs
from geolith.operators import retrieval as rt
from geolith.operators import scoring as sc
from geolith.operators import slots as sl
from geolith.operators import training as tr
from geolith.schemas import MENTION, PLACE
from geolith.sources.readers import input_kind, story_events
from geolith.sources.scratch import stored


@dataclass
class Geoparser:
    """Plug-ins, tables and switches of the job. gazetteer and index (ranked_index, or phrase_index) are tables; vectors are needed by the neural scorer alone.

    index None: there is no stored one, the gazetteer is scanned for the phrases that the mentions ask for.
    """

    gazetteer: DataFrame
    index: DataFrame | None
    tagger: mn.Tagger | None = None
    hierarchy: DataFrame | None = None
    feature_codes: DataFrame | None = None
    countries: DataFrame | None = None
    weights: tuple[float, ...] | dict[str, np.ndarray] = field(default=sc.WEIGHTS)
    max_choices: int = 100
    fallback: bool = True
    strict: bool = False

    def __post_init__(self) -> None:
        if self.tagger is not None:
            mn.check_tagger(self.tagger)

    def check(self) -> None:
        """Raise if a table that every search needs is not there or empty. It costs a look at a row of each."""
        if gone := gz.missing({"gazetteer": self.gazetteer} | ({} if self.index is None else {"index": self.index})):
            raise ValueError(f"no rows in {', '.join(gone)}")

    def mentions(self, docs: DataFrame) -> DataFrame:
        """From the text column, each distinct text once, or from the tokens column.

        Rows of one doc_id with different texts are parts of one document: their mentions are numbered through. A null
        doc_id names no document; such rows have no mentions.
        """
        if input_kind(docs) == "tokens":
            return mn.mentions_of_tokens(docs, self.strict)
        mn.check_tagger(self.tagger)
        rows = mn.once_per_text(docs, lambda once: mn.extract_mentions(once, self.tagger, self.strict, "text_key", "string"), keep=True).where("doc_id is not null")
        order = Window.partitionBy("doc_id").orderBy("text_key", "mention_id")
        rows = rows.withColumn("mention_id", F.row_number().over(order) - 1)
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.split()[0] for c in MENTION.split(", ")[1:]))

    def _found(self, mentions: DataFrame, every: bool, **only: object) -> DataFrame:
        """Candidates with the features that a mention gives alone, dealt by document."""
        if self.index is None:
            return self._found_by_scan(mentions, every, **only)
        k = self.max_choices if self.strict else self.max_choices - 2
        found = rt.candidates(mentions, self.index, self.gazetteer, k, fallback=self.fallback, strict=self.strict, every=every, **only)
        how = "left" if every else "inner"
        rows = found.join(self.gazetteer.select(*PLACE, "asciiname", "alternativenames"), "geonameid", how)
        rows = rows.join(rt.parents(mentions, self.index, self.gazetteer), "in_rel", "left").repartition("doc_id")
        return ft.parent_features(ft.name_features(rows), self.strict).drop("search_name", "in_rel", "parent_country", "parent_adm1", "alternativenames")

    def _found_by_scan(self, mentions: DataFrame, every: bool, **only: object) -> DataFrame:
        """_found's rows without an index: what distinct names need is taken from scans of the gazetteer, which is never moved, and their candidates join the mentions, dealt by document before."""
        spark, k = mentions.sparkSession, self.max_choices if self.strict else self.max_choices - 2
        names = stored(mentions.select("search_name").distinct())
        inside = stored(mentions.where("in_rel <> ''").select("in_rel").distinct())
        phrases = lambda of: of.select(normal(F.col("query")).alias("phrase")).where("phrase <> ''").distinct()
        outer = stored(phrases(inside.select(F.col("in_rel").alias("query"))))
        wanted = stored(phrases(names.select(clean_search_name(F.col("search_name"), self.strict).alias("query"))).union(outer).distinct())
        index = stored(gz.ranked_index(self.gazetteer, wanted))
        asked = names.select(F.lit(0).alias("doc_id"), F.lit(0).alias("mention_id"), "search_name", F.lit("").alias("in_rel"))
        search = lambda fallback: stored(rt.candidates(asked, index, self.gazetteer, k, fallback=fallback, strict=self.strict, every=True, **only).select("search_name", "slot", "geonameid"))
        found = search(False)
        if self.fallback and not found.where("geonameid IS NULL").isEmpty():
            found = search(True)
        ids = stored(found.where("geonameid IS NOT NULL").select("geonameid").distinct())
        facts = stored(self.gazetteer.select(*PLACE, "asciiname", "alternativenames").join(ids, "geonameid", "left_semi"))
        named = stored(ft.name_features(found.join(facts, "geonameid", "left"), ("search_name",)).drop("alternativenames"))
        outer_ids = stored(index.join(outer, "phrase", "left_semi").select("geonameid").distinct())
        areas = stored(self.gazetteer.where(F.col("feature_code").isin("PCLI", "ADM1")).join(outer_ids, "geonameid", "left_semi"))
        parents = stored(rt.parents(inside.select("in_rel"), index, areas))
        size = max(int(spark.conf.get("spark.sql.shuffle.partitions")), mentions.count() // 5000)  # a row becomes k rows in its task
        rows = mentions.select("doc_id", "mention_id", "search_name", "in_rel").repartition(size, "doc_id")
        few = named if named.count() > 200_000 else F.broadcast(named)
        rows = rows.join(few if every else few.where("geonameid IS NOT NULL"), "search_name", "left" if every else "inner").join(parents, "in_rel", "left")
        return ft.parent_features(rows, self.strict).drop("search_name", "in_rel", "parent_country", "parent_adm1")

    def candidates(self, mentions: DataFrame, **only: object) -> DataFrame:
        """Candidates with features; room is left for the slot of no entry and the last one (strict: for none)."""
        return ft.coherence(ft.with_null_candidate(self._found(mentions, False, **only), mentions), self.strict)

    def decided(self, mentions: DataFrame, top_n: int = 1, vectors: DataFrame | None = None, **only: object) -> DataFrame:
        """resolve's rows for mentions. The linear scorer works on one array a mention; the neural one on packed slots."""
        keep = (*PLACE, "asciiname", *ft.FEATURES)
        if not isinstance(self.weights, dict):
            rows = ft.coherence(self._found(mentions, True, **only), self.strict)
            return rs.resolve_arrays(sl.scored(rows, self.max_choices, self.weights, keep, strict=self.strict), top_n, self.strict)
        codes = ft.coded(self.candidates(mentions, **only), self.feature_codes, self.countries)
        null = self.countries.where("code3 = 'NULL'").first().idx
        slots = ft.packed(codes, self.max_choices, null, keep)
        scores = sc.neural_scores(slots, vectors, self.weights)
        return rs.resolve(slots.join(scores, ["doc_id", "mention_id", "slot"]), self.max_choices, top_n, self.strict)

    def _resolved(self, found: DataFrame, top_n: int = 1, trim: bool = True, vectors: DataFrame | None = None, **only: object) -> DataFrame:
        best = self.decided(found, top_n, vectors, **only)
        places = best.select(*(c for c in best.columns if c != "place"), "place.*").drop("real")
        if self.hierarchy is not None:
            places = rs.with_city(places, self.gazetteer, self.hierarchy, self.strict)
        places = found.select("doc_id", "mention_id", "search_name", "start_char", "end_char").join(places, ["doc_id", "mention_id"])
        return rs.trimmed(places, trim)

    def resolved(self, docs: DataFrame, top_n: int = 1, trim: bool = True, vectors: DataFrame | None = None, **only: object) -> DataFrame:
        """A row per mention (top_n rows, as many as there are): the mention, the place or nulls with a reason, score, city.

        Texts are tagged once, here, into a scratch table that the result reads; scratch.discard deletes it.
        """
        return self._resolved(stored(self.mentions(docs)), top_n, trim, vectors, **only)

    def documents(self, docs: DataFrame, **options: object) -> DataFrame:
        """A row per document with its places as an array. Texts are tagged once."""
        found = stored(self.mentions(docs))
        return rs.documents_out(docs, self._resolved(found, **options), mn.event_location_text(found))

    def events(self, stories: DataFrame, answerer: ev.Answerer, info: DataFrame, limit: int = -1) -> DataFrame:
        """Stories (the first `limit`, all if that is negative) with their events, or events a row each, to one row per event with its location."""
        rows = rs.first_n(stories, limit)
        rows = ev.event_documents(story_events(rows) if "events" in rows.columns else rows).withColumn("text_key", F.sha2("doc_text", 256))
        texts = tr.numbered(rows.groupBy("text_key").agg(F.first("doc_text").alias("text")), "text_key").withColumnRenamed("row_number", "doc_id")
        own = self.documents(texts.select("doc_id", "text")).join(texts.select("doc_id", "text_key"), "doc_id").select("text_key", F.col("geolocated_ents").alias("geo"))
        rows = ev.mentions_before(rows.join(own, "text_key").drop("text_key"))
        return ev.event_rows(ev.pick_event_location(ev.answers(rows, answerer), self.strict), info)

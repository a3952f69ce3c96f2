"""Jobs for spark-submit: python -m geolith.plans.cli JOB, with options or a configuration file.

gazetteer   a dump and its lookup tables -> the gazetteer
index       the gazetteer -> the ranked phrase index
geoparse    documents -> resolved places
events      stories with events, or coded events -> a CSV of events with their locations
nlp_docs    annotated corpora by source -> their distinct texts, annotations and mentions
training    what nlp_docs wrote -> candidates with labels, by source and search
evaluate    scored candidates -> metrics by dataset
"""

from __future__ import annotations

import argparse
import configparser
import importlib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import evaluate, features, gazetteer, mentions, resolve, training
from geolith.plans.geoparse import Geoparser
from geolith.sources import readers, scratch, sinks


@dataclass
class Config:
    """Paths and switches; an INI file's sections are read as one."""

    dump: str = ""
    adm1: str = ""
    adm2: str = ""
    countries: str = ""
    hierarchy: str = ""
    gazetteer: str = ""
    index: str = ""
    names: str = ""
    documents: str = ""
    scored: str = ""
    out: str = ""
    stories: str = ""
    coded_events: str = ""
    base_dir: str = ""
    sources: str = "tr, lgl, gwn, prodigy, syn_cities, syn_caps, wiki"
    tagger: str = ""
    answerer: str = ""
    max_choices: int = 100
    fuzzy: int = 0
    limit_types: int = 0
    limit: int = -1


#: Where a source's corpus lies under the folder of training data.
PATHS = {
    "tr": "Pragmatic-Guide-to-Geoparsing-Evaluation/data/Corpora/TR-News.xml", "lgl": "Pragmatic-Guide-to-Geoparsing-Evaluation/data/Corpora/lgl.xml", "gwn": "Pragmatic-Guide-to-Geoparsing-Evaluation/data/GWN.xml",
    "prodigy": "prodigy/loc_rank_db.jsonl", "syn_cities": "synth_raw/synthetic_cities_short.jsonl", "syn_caps": "synth_raw/synth_caps.jsonl", "wiki": "wiki/wiki_training_data_sents.jsonl",
}


def read_config(path: str | None, **given: object) -> Config:
    """The file's values, then those that are given and not None."""
    own = configparser.ConfigParser()
    if path:
        own.read(path)
    found = {k: v for s in own.sections() for k, v in own[s].items()}
    found |= {k: v for k, v in given.items() if v is not None}
    kinds = {f.name: type(f.default) for f in fields(Config)}
    return Config(**{k: kinds[k](v) for k, v in found.items() if k in kinds})


def markdown(rows, columns: list[str]) -> str:
    """A table of collected metric rows."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def plug_in(name: str):
    """The object package.module:name, such as a tagger or an answerer."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, with a plain message if it is not there."""
    if not path or not gazetteer.table_exists(spark, path if "/" in path else f"./{path}"):
        raise SystemExit(f"no such table: {path or '(no path given)'}")
    return spark.read.parquet(path)


def make_tagger(spark: SparkSession, c: Config) -> mentions.Tagger:
    if c.tagger:
        return plug_in(c.tagger)
    return mentions.DictionaryTagger([r.value for r in spark.read.text(c.names).collect()])  # the tagger's dictionary is a parameter


def make_parser(spark: SparkSession, c: Config) -> Geoparser:
    up = readers.read_hierarchy(spark, c.hierarchy) if c.hierarchy else None
    parser = Geoparser(table(spark, c.gazetteer), table(spark, c.index), make_tagger(spark, c), up, max_choices=c.max_choices)
    parser.check()
    return parser


def nlp_docs(spark: SparkSession, c: Config) -> None:
    """Of each source: out/docs, out/gold and out/mentions, each partitioned by source."""
    tagger = make_tagger(spark, c)
    mentions.check_tagger(tagger)
    for source in map(str.strip, c.sources.split(",")):
        docs, gold = training.parsed_documents(readers.read_corpus(spark, f"{c.base_dir}/{PATHS[source]}"), source)
        for name, rows in (("docs", docs), ("gold", gold), ("mentions", mentions.extract_mentions(docs, tagger))):
            sinks.replace_table(rows, f"{c.out}/{name}", source=source)


def training_data(spark: SparkSession, c: Config) -> None:
    """Of each source: the labelled mentions' candidates with features and is_correct, under source, max_choices, limit_types and fuzzy; wiki_incorrect is wiki without the right candidates."""
    parser = make_parser(spark, c)
    for source in map(str.strip, c.sources.split(",")):
        stored_as = "wiki" if source == "wiki_incorrect" else source
        found, gold = (readers.read_table(spark, f"{c.base_dir}/{x}", source=stored_as).drop("source") for x in ("mentions", "gold"))
        labelled = training.attach_gold(found, gold).select("doc_id", "mention_id", "gold_id")
        rows = parser.candidates(found, limit_types=bool(c.limit_types), fuzzy=c.fuzzy).join(labelled, ["doc_id", "mention_id"])
        rows = training.labelled_only(rows)
        rows = features.without_gold(rows) if source == "wiki_incorrect" else rows
        sinks.replace_table(features.correct(rows), c.out, source=source, max_choices=c.max_choices, limit_types=c.limit_types, fuzzy=c.fuzzy)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=["gazetteer", "index", "geoparse", "events", "nlp_docs", "training", "evaluate"])
    p.add_argument("--config")
    for f in fields(Config):
        p.add_argument(f"--{f.name.replace('_', '-')}")
    given = vars(p.parse_args(args))
    job = given.pop("job")
    c = read_config(given.pop("config"), **given)
    spark = SparkSession.builder.getOrCreate()
    before = scratch.made()
    if job == "gazetteer":
        info = readers.read_country_info(spark, c.countries)
        rows = gazetteer.build_gazetteer(readers.read_dump(spark, c.dump), gazetteer.iso_codes(info), readers.read_admin(spark, c.adm1), readers.read_admin(spark, c.adm2))
        sinks.write_gazetteer(rows, c.gazetteer)
    elif job == "index":
        gazetteer.ranked_index(table(spark, c.gazetteer)).repartition("phrase").sortWithinPartitions("phrase", "rank").write.mode("overwrite").parquet(c.index)
    elif job == "geoparse":
        make_parser(spark, c).resolved(resolve.first_n(table(spark, c.documents), c.limit)).write.mode("overwrite").parquet(c.out)
    elif job == "events":
        rows = readers.coded_events(readers.read_coded_events(spark, c.coded_events)) if c.coded_events else readers.read_stories(spark, c.stories)
        info = readers.read_country_info(spark, c.countries).select(F.col("ISO3").alias("code3"), F.col("Country").alias("name"))
        sinks.write_csv(make_parser(spark, c).events(rows, plug_in(c.answerer), info, c.limit), c.out)
    elif job == "nlp_docs":
        nlp_docs(spark, c)
    elif job == "training":
        training_data(spark, c)
    else:
        out = evaluate.evaluate(spark.read.parquet(c.scored), "dataset").orderBy("dataset")
        print(markdown(out.collect(), out.columns))
    scratch.discard(spark, before)


if __name__ == "__main__":
    main()

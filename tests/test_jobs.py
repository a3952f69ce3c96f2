"""SQL functions and jobs."""

import json

import pytest
from pyspark.sql import functions as F

from geolith import schemas
from geolith.functions import sql
from geolith.operators.mentions import DictionaryTagger
from geolith.plans import cli
from geolith.sources import readers


def test_sql_functions(spark):
    sql.register(spark, DictionaryTagger(["Berlin", "Germany"]))
    assert spark.sql("SELECT clean_search_name('Quezon City'), clean_search_name('US'), normal_name('Foo-Bar  x'), round(haversine_km(0, 0, 0, 1), 2)").first() == ("Quezon", "United States", "foo bar x", 111.2)
    rows = spark.sql("SELECT id, m.* FROM VALUES (1, 'Berlin in Germany.'), (2, '') AS t(id, body), LATERAL place_mentions(body) m").collect()
    assert [(r.id, r.search_name, r.in_rel) for r in rows] == [(1, "Berlin", "Germany"), (1, "Germany", "")]


def answerer(questions, contexts):
    return [(c.find("Berlin"), c.find("Berlin") + 6, "Berlin") for c in contexts]


def stories(tmp_path):
    story = {"Headline": "Head", "Rawtext": "Protest in Berlin today.", "storyid": 1, "events": [{"event_id": 10, "text": "Protest in Berlin today.", "name": "Protest", "sentence_num": 0}]}
    (tmp_path / "stories.jsonl").write_text(json.dumps(story) + "\n")
    return f"{tmp_path}/stories.jsonl"


def corpora(base):
    """One small corpus of each source, in its own layout."""
    for path in cli.PATHS.values():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
    text = "In Berlin, near Germany."
    article = lambda fields: f"<articles><article><text>{text}</text><toponyms><toponym><start>3</start><end>9</end>{fields}</toponym><toponym><start>16</start><end>23</end>{fields}</toponym></toponyms></article></articles>"
    for source in ("tr", "lgl"):
        (base / cli.PATHS[source]).write_text(article("<phrase>x</phrase><gaztag geonameid='1'/>"))
    (base / cli.PATHS["gwn"]).write_text(article("<extractedName>x</extractedName><geonamesID>1</geonamesID>"))
    for source in ("syn_cities", "syn_caps"):
        own = [{"start": a, "end": b, "placename": "x", "geonamesID": "1"} for a, b in ((3, 9), (16, 23))]
        (base / cli.PATHS[source]).write_text(json.dumps({"text": text, "toponyms": {"toponym": own}}) + "\n")
    (base / cli.PATHS["prodigy"]).write_text("".join(json.dumps({"text": text, "answer": "accept", "accept": ["a"], "options": [{"id": "a", "text": "Berlin 1"}], "spans": [{"start": a, "end": b}]}) + "\n" for a, b in ((3, 9), (16, 23))))
    (base / cli.PATHS["wiki"]).write_text("".join(json.dumps({"text": text, "correct_geonamesid": 1, "start_char_sent": a, "end_char_sent": b}) + "\n" for a, b in ((3, 9), (16, 23))))


def test_training_jobs(spark, tmp_path):
    t = str(tmp_path)
    corpora(tmp_path)
    (tmp_path / "names.txt").write_text("Berlin\nGermany\n")
    row = lambda i, name, code, cls: (i, name, name, [name], 1.0, 2.0, cls, code, "DEU", "", "", "", "", "", "", 0, 1, None)
    places = spark.createDataFrame([row("1", "Berlin", "PPLC", "P"), row("2", "Germany", "PCLI", "A"), row("3", "Berlin", "PPL", "P")], schemas.GAZETTEER)
    places.write.parquet(f"{t}/gaz")
    cli.main(["index", "--gazetteer", f"{t}/gaz", "--index", f"{t}/index"])
    cli.main(["nlp_docs", "--base-dir", t, "--names", f"{t}/names.txt", "--out", f"{t}/parsed"])
    for source in cli.PATHS:
        docs, gold, found = (readers.read_table(spark, f"{t}/parsed/{x}", source=source) for x in ("docs", "gold", "mentions"))
        assert [(r.doc_id, r.text) for r in docs.collect()] == [(0, "In Berlin, near Germany.")]
        assert sorted((r.doc_id, r.start, r.end, r.gold_id) for r in gold.collect()) == [(0, 3, 9, "1"), (0, 16, 23, "1")] and found.count() == 2
    args = ["training", "--base-dir", f"{t}/parsed", "--gazetteer", f"{t}/gaz", "--index", f"{t}/index", "--names", f"{t}/names.txt", "--max-choices", "6", "--out", f"{t}/train"]
    for _ in range(2):  # a second run replaces the first
        cli.main([*args, "--sources", ", ".join(cli.PATHS) + ", wiki_incorrect"])
    rows = spark.read.parquet(f"{t}/train")
    for source in cli.PATHS:
        own = rows.where(F.col("source") == source)
        assert sorted((r.mention_id, r.geonameid, r.is_correct) for r in own.where("geonameid <> 'NULL'").collect()) == [(0, "1", True), (0, "3", False), (1, "2", False)]
    assert not rows.where("source = 'wiki_incorrect' AND geonameid = '1'").count() and rows.where("source = 'wiki_incorrect'").count() and rows.where("max_choices = 6 AND fuzzy = 0").count() == rows.count()


def test_jobs(spark, tmp_path, capsys):
    t = str(tmp_path)
    row = lambda *x: "\t".join([*x, *[""] * (19 - len(x))])
    (tmp_path / "dump.txt").write_text("\n".join([row("1", "Berlin", "Berlin", "Berlim", "52.5", "13.4", "P", "PPLC", "DE", "", "16"), row("2", "Germany", "Germany", "", "51", "9", "A", "PCLI", "DE", "", "00")]))
    (tmp_path / "a1.txt").write_text("DE.16\tBerlin\tBerlin\t1\n")
    (tmp_path / "a2.txt").write_text("DE.16.1\tx\tx\t1\n")
    (tmp_path / "c.txt").write_text("ISO\tISO3\tCountry\nDE\tDEU\tGermany\n")
    (tmp_path / "names.txt").write_text("Berlin\nGermany\n")
    (tmp_path / "job.ini").write_text(f"[paths]\ngazetteer = {t}/gaz\nindex = {t}/index\nnames = {t}/names.txt\ndocuments = {t}/docs\nout = {t}/out\n[options]\nmax_choices = 6\nlimit = -1\n")
    spark.createDataFrame([(1, "Seen in Berlin, Germany.")], "doc_id long, text string").write.parquet(f"{t}/docs")
    cli.main(["gazetteer", "--config", f"{t}/job.ini", "--dump", f"{t}/dump.txt", "--adm1", f"{t}/a1.txt", "--adm2", f"{t}/a2.txt", "--countries", f"{t}/c.txt"])
    cli.main(["index", "--config", f"{t}/job.ini"])
    cli.main(["geoparse", "--config", f"{t}/job.ini"])
    assert spark.read.parquet(f"{t}/out").count() == 2
    assert cli.read_config(f"{t}/job.ini").max_choices == 6 and cli.read_config(None, limit="3").limit == 3
    cli.main(["events", "--config", f"{t}/job.ini", "--stories", stories(tmp_path), "--countries", f"{t}/c.txt", "--answerer", "tests.test_jobs:answerer", "--out", f"{t}/events", "--max-choices", "6"])
    rows = spark.read.csv(f"{t}/events", header=True, multiLine=True, escape='\\').collect()
    assert [(r.event_id, r.place, r.country, r.extracted_name) for r in rows] == [("10", "Berlin", "Germany", "Berlin")]
    (tmp_path / "icews.tsv").write_text("\t".join(["E1", "d", *["x"] * 3, "Protest", *["x"] * 5, "S1", "2", "A protest in Berlin.", "pub", "src", "Head", *["x"] * 9]) + "\n")
    cli.main(["events", "--config", f"{t}/job.ini", "--coded-events", f"{t}/icews.tsv", "--countries", f"{t}/c.txt", "--answerer", "tests.test_jobs:answerer", "--out", f"{t}/events2"])
    assert [(r.event_id, r.storyid, r.text, r.place) for r in spark.read.csv(f"{t}/events2", header=True, multiLine=True).collect()] == [("E1", "S1", "A protest in Berlin.", "Berlin")]
    with pytest.raises(SystemExit):
        cli.main(["geoparse", "--gazetteer", f"{t}/none", "--index", f"{t}/index", "--names", f"{t}/names.txt", "--documents", f"{t}/docs", "--out", f"{t}/x"])
    cols = "dataset string, doc_id long, mention_id int, slot int, score double, is_correct boolean, geonameid string, country_code3 string, feature_code string, admin1_code string, lat double, lon double"
    spark.createDataFrame([("a", 1, 0, 0, 1.0, True, "1", "DEU", "PPL", "1", 0.0, 0.0), ("a", 1, 0, 1, 0.0, False, "NULL", "NULL", "NULL", "NULL", 0.0, 0.0)], cols).write.parquet(f"{t}/scored")
    cli.main(["evaluate", "--scored", f"{t}/scored"])
    assert "| a | 1 | 1.000 |" in capsys.readouterr().out

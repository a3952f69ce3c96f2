"""Readers, gazetteer, mentions, retrieval, features, scoring, decisions, events, evaluation, training, streams."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import Observation, Row, Window
from pyspark.sql import functions as F

from geolith import schemas
from geolith.functions import math as fm
from geolith.functions import text as fx
from geolith.operators import evaluate, events, features, gazetteer, mentions, resolve, retrieval, scoring, slots, training
from geolith.plans import queries
from geolith.plans.geoparse import Geoparser
from geolith.sources import readers, sinks
from geolith.streaming.job import resolve_stream

DAY = datetime.date(2024, 1, 1)


def place(gid, name, alts=(), cls="P", code="PPL", country="DEU", adm1="16", adm1_name="Berlin", lat=52.5, lon=13.4, n=None, pop=0):
    return (gid, name, name, [*alts], lat, lon, cls, code, country, adm1, adm1_name, "", "", "", "", pop, len(alts) if n is None else n, DAY)


@pytest.fixture(scope="module")
def gaz(spark):
    rows = [
        place("2950159", "Berlin", ["Berlin", "Berlim"], code="PPLC", n=90), place("4500771", "Berlin", country="USA", adm1="NJ", adm1_name="New Jersey", n=3), place("6944049", "Alexanderplatz", cls="S", code="SQR", n=5),
        place("2921044", "Federal Republic of Germany", ["Germany", "Deutschland"], cls="A", code="PCLI", adm1="00", adm1_name="", n=80), place("2749879", "Provincie Noord-Holland", ["North Holland"], cls="A", code="ADM1", country="NLD", adm1="07", adm1_name="North Holland", n=20),
        place("5128638", "New York", ["New York"], cls="A", code="ADM1", country="USA", adm1="NY", adm1_name="New York", n=60), place("7", "Mitte", code="PPLX", n=4), place("8", "Lone Section", code="PPLX", n=4), place("9", "Spandau", code="PPL", n=2),
    ]
    return spark.createDataFrame(rows, schemas.GAZETTEER).cache()


@pytest.fixture(scope="module")
def index(gaz):
    return gazetteer.phrase_index(gaz).cache()


def test_scans(spark, tmp_path):
    dump = tmp_path / "dump.txt"
    row = lambda *x: "\t".join(x)
    dump.write_text("\n".join([
        row("6252001", "United States", "United States", "", "39.7", "-98.5", "A", "PCLI", "US", "", "00", "", "", "", "327167434", "", "", "", "x"),
        row("1", "Ḩadīqat", "Hadiqat", "Ḩadīqat ash Shahbā,北京", "1", "2", "P", "PPL", "SY", "", "03", "7", "", "", "", "", "", "", "x"),
        row("2", "bad", "bad", "", "north", "2", "P", "PPL", "SY", "", "", "", "", "", "", "", "", "", "x"), "short",
    ]))
    raw = readers.read_dump(spark, str(dump))
    assert raw.where("valid").count() == 2 and raw.where("alternates IS NULL").count() == 0
    (tmp_path / "a1.txt").write_text("SY.03\told\told\t1\nSY.03\tHoms\tHoms\t2\n")
    (tmp_path / "a2.txt").write_text("XX.1.1\tnone\tnone\t1\n")
    (tmp_path / "h.txt").write_text("10\t1\tADM\n11\t1\tADM\nonly\n12\t2\n")
    (tmp_path / "c.txt").write_text("ISO\tISO3\tCountry\nUS\tUSA\tUnited States\nSY\tSYR\tSyria\nNA\tNAM\tNamibia\n")
    a1, a2 = (readers.read_admin(spark, str(tmp_path / f"a{k}.txt")) for k in (1, 2))
    assert [r.name for r in a1.collect()] == ["Homs"]
    assert {(r.child_id, r.parent_id) for r in readers.read_hierarchy(spark, str(tmp_path / "h.txt")).collect()} == {("1", "11"), ("2", "12")}
    info = readers.read_country_info(spark, str(tmp_path / "c.txt"))
    assert "NA" in [r.ISO for r in info.collect()]
    seen = Observation("load")
    rows = {r.geonameid: r for r in gazetteer.build_gazetteer(raw, gazetteer.iso_codes(info), a1, a2, day=DAY, counted=seen).collect()}
    assert set(rows["6252001"].alternativenames) == {"", "US", "U.S."} and rows["6252001"].alt_name_length == 3 and rows["6252001"].country_code3 == "USA"
    assert rows["1"].alternativenames == ["Ḩadīqat ash Shahbā", "北京", "Hadiqat ash Shahba"] and rows["1"].alt_name_length == 2 and rows["1"].admin1_name == "Homs"
    assert seen.get["rows"] == 4 and seen.get["invalid"] == 2 and seen.get["no_adm2"] == 2
    (tmp_path / "iso.csv").write_text("English short name,Alpha-2 code,Alpha-3 code\nA,AA,AAA\nNamibia,NA,NAM\n")
    codes = {r.code3: r.idx for r in readers.read_country_codes(spark, str(tmp_path / "iso.csv")).collect()}
    assert codes["AAA"] == 0 and codes["NAM"] == 1 and codes["NULL"] == 8 and codes["NA"] == 9
    (tmp_path / "f.json").write_text(json.dumps({"PPL": 0, "NULL": 52}))
    assert {r.feature_code: r.idx for r in readers.read_feature_codes(spark, str(tmp_path / "f.json")).collect()} == {"PPL": 0, "NULL": 52}


def test_stories_corpora_and_tables(spark, tmp_path):
    story = {"Headline": "H", "Rawtext": "R", "storyid": 1, "events": [{"event_id": 1, "text": "t", "name": "N", "sentence_num": 0}, {"event_id": 2, "text": "u", "name": "M", "sentence_num": 1}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(story) + "\n")
    rows = readers.story_events(readers.read_stories(spark, str(tmp_path / "s.jsonl")))
    assert {(r.storyid, r.event_id, r.name) for r in rows.collect()} == {(1, 1, "N"), (1, 2, "M")}
    assert readers.read_corpus(spark, str(tmp_path / "s.jsonl")).count() == 1
    (tmp_path / "c.xml").write_text("<articles><article><text>In Homs.</text><toponyms><toponym><start>3</start><end>7</end><phrase>Homs</phrase><gaztag geonameid='169577'/></toponym><toponym><start>0</start><end>1</end><phrase>x</phrase><gaztag/></toponym></toponyms></article></articles>")
    gold = training.from_toponyms(readers.read_corpus(spark, str(tmp_path / "c.xml")), "lgl").collect()
    assert [(r.start, r.end, r.name, r.gold_id) for r in gold] == [(3, 7, "Homs", "169577")]
    with pytest.raises(ValueError):
        readers.read_corpus(spark, "x.csv")
    (tmp_path / "e.tsv").write_text("\t".join(str(i) for i in range(26)) + "\n")
    coded = readers.read_coded_events(spark, str(tmp_path / "e.tsv"))
    assert coded.columns == [
        "Event ID", "Event Date", "Source Name", "Source Sectors", "Source Country", "Event Text", "CAMEO Code", "Intensity", "Target Name", "Target Sectors", "Target Country", "Story ID", "Sentence Number",
        "Event Sentence", "Publisher", "Source", "Headline", "City", "District", "Province", "Country", "Latitude", "Longitude", "productID", "holdingID", "Language",
    ]
    assert [coded.first()[c] for c in coded.columns] == [str(i) for i in range(26)]
    assert readers.coded_events(coded).first().asDict() == {"storyid": "11", "event_id": "0", "Headline": "16", "Rawtext": "13", "text": "13", "name": "5", "sentence_num": 12}
    sinks.write_table(spark.range(3), str(tmp_path / "t"), source="a", fuzzy=0)
    sinks.write_table(spark.range(2), str(tmp_path / "t"), source="b", fuzzy=0)
    assert readers.read_table(spark, str(tmp_path / "t"), source="b").count() == 2
    sinks.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id"]
    table = spark.createDataFrame([("1", "a"), ("2", "b")], "geonameid string, name string")
    assert {tuple(r) for r in sinks.upsert(table, spark.createDataFrame([("2", "c"), ("3", "d")], table.schema)).collect()} == {("1", "a"), ("2", "c"), ("3", "d")}
    sinks.save_weights({"w": np.arange(3)}, str(tmp_path / "w.npz"))
    assert sinks.load_weights(str(tmp_path / "w.npz"))["w"].tolist() == [0, 1, 2]
    assert json.loads(spark.range(1).select(sinks.as_json("id").alias("j")).first().j) == {"id": 0}
    for kind in ("text", "tokens"):
        assert readers.input_kind(spark.createDataFrame([("x",)], f"{kind} string")) == kind
    with pytest.raises(ValueError):
        readers.input_kind(spark.range(1))


@pytest.mark.parametrize("name,strict,fixed", [("Quezon City", "Quezon", "Quezon"), ("US", "United States", "United States"), ("Kent county's", "Kent", "Kent"), ("theodore", "odore", "theodore"), ("the Hague", "Hague", "Hague"), ("The Hague", "The Hague", "The Hague"), ("Northern Territory", "Northern Territory", "Northern"), ("Region", "", "")])
def test_clean_search_name(spark, name, strict, fixed):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(fx.clean_search_name(F.col("n"), True), fx.clean_search_name(F.col("n"))).first()) == (strict, fixed)


def test_numbers(spark):
    w = Window.partitionBy("g")
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 0.0), (2, 0.0)], "g int, x double")
    assert sorted(r[0] for r in df.select(fm.min_max(F.col("x"), w)).collect()) == [0, 0, 0, 0.5]
    km = spark.range(1).select(fm.haversine_km(F.lit(52.52437), F.lit(13.41053), F.lit(52.5225), F.lit(13.415))).first()[0]
    assert abs(km - 0.3663) < 0.001
    assert abs(spark.range(1).select(fm.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))).first()[0] - 0.96) < 1e-9
    assert abs(sum(r[0] for r in df.select(fm.softmax(F.col("x"), Window.partitionBy(F.lit(1)))).collect()) - 1) < 1e-9
    assert spark.range(1).select(fm.coordinates(F.lit(1.5), F.lit(-2.0))).first()[0] == "1.5,-2.0"


def test_dictionary_tagger_takes_the_longest_name():
    tag = mentions.DictionaryTagger({"New York": "GPE", "York": "GPE", "New York City": "GPE", "the Rhine": "LOC"})
    text = "In New York City, york and New York. The Rhine"
    tokens = mentions.tokenise(text)
    assert [(text[tokens[i][1] : tokens[j - 1][2]], x) for i, j, x in tag(tokens)] == [("New York City", "GPE"), ("New York", "GPE"), ("The Rhine", "LOC")]


def test_mentions_from_text_and_tokens_agree(spark):
    text = "I visited Paris, France. Berlin too."
    tag = mentions.DictionaryTagger({"Paris": "GPE", "France": "GPE", "Berlin": "PERSON"})
    from_text = mentions.extract_mentions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), tag).collect()
    tokens = mentions.tokenise(text)
    labels = {i: x for a, b, x in tag(tokens) for i in range(a, b)}
    rows = [(1, [(*t, labels.get(i, "")) for i, t in enumerate(tokens)])]
    from_tokens = mentions.mentions_of_tokens(spark.createDataFrame(rows, f"doc_id long, tokens array<{schemas.TOKEN}>")).collect()
    assert from_text == from_tokens and [(r.search_name, r.in_rel, r.start_char) for r in from_text] == [("Paris", "France", 10), ("France", "", 17)]


def test_vectors(spark):
    word_pieces = spark.createDataFrame([(1, 0, [1.0, 3.0]), (1, 0, [3.0, 5.0]), (1, 1, None), (1, 2, [0.0, 2.0])], "doc_id long, token int, vec array<double>")
    got = {r.token: r.vec for r in mentions.token_vectors(word_pieces).collect()}
    assert got == {0: [2.0, 4.0], 1: [], 2: [0.0, 2.0]}
    tokens = spark.createDataFrame([(1, 0, "GPE", [2.0, 4.0]), (1, 1, "", [0.0, 0.0]), (1, 2, "NORP", [4.0, 2.0])], "doc_id long, token int, label string, vec array<double>")
    found = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3)], "doc_id long, mention_id int, first int, last int")
    rows = {r.mention_id: r for r in mentions.context_vectors(tokens, found, 2).collect()}
    assert rows[0].tensor == [2, 4] and rows[0].locs_tensor == [4, 2] and rows[1].locs_tensor == [2, 4] and rows[1].doc_tensor == [2, 2]
    none = mentions.context_vectors(tokens.where("label = ''"), found.limit(1), 2).first()
    assert none.tensor == [0, 0] and none.locs_tensor == [0, 0]
    marked = spark.createDataFrame([(1, 5, "B", "EVENT_LOC"), (1, 1, "A", "EVENT_LOC"), (1, 2, "C", "GPE"), (2, 0, "D", "GPE")], "doc_id long, start_char int, search_name string, label string")
    assert {r.doc_id: r.event_location_raw for r in mentions.event_location_text(marked).collect()} == {1: "A B", 2: ""}


def test_phrase_index_equals_the_plain_test(spark, gaz, index):
    names = spark.createDataFrame([(x,) for x in ("Berlin", "berlin", "New York", "York", "north holland", "Holland North", "of Germany", "erlin", "", "Republic of", "Noord Holland")], "query string")
    fast = retrieval.phrase_search(names, index, gaz, 50).select("query", "geonameid")
    every = gazetteer.all_names(gaz).withColumn("n", F.concat(F.lit(" "), fx.normal(F.col("place_name")), F.lit(" ")))
    slow = names.join(every, F.col("n").contains(F.concat(F.lit(" "), fx.normal(F.col("query")), F.lit(" ")))).where("query <> ''").select("query", "geonameid").distinct()
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.count() >= 8
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_seven_words_and_more_meet_their_entries(spark):
    uk, helena, georgia = "United Kingdom of Great Britain and Northern Ireland", "Saint Helena, Ascension and Tristan da Cunha", "South Georgia and the South Sandwich Islands"
    long = " ".join(f"w{i}" for i in range(40))
    own = spark.createDataFrame([place("1", "Britain", [uk], cls="A", code="PCLI", country="GBR"), place("2", helena, cls="A", code="ADM1", country="SHN", adm1_name="SH"), place("3", georgia, n=2), place("4", "Islands", n=9), place("5", long)], schemas.GAZETTEER)
    ind = gazetteer.phrase_index(own)
    q = lambda *x: spark.createDataFrame([(n,) for n in x], "query string")
    asked = q(uk, helena, georgia, long, long[3:], "Georgia and the South Sandwich Islands", georgia + " Territory", uk.replace("Great", "Little"))
    assert {(r.query, r.geonameid) for r in retrieval.phrase_search(asked, ind, own).collect()} == {(uk, "1"), (helena, "2"), (georgia, "3"), (long, "5"), (long[3:], "5"), ("Georgia and the South Sandwich Islands", "3")}
    assert [r.geonameid for r in retrieval.search(q(georgia), ind, own, 1).collect()] == ["3"]
    assert [r.geonameid for r in retrieval.country_by_name(q(uk), ind, own).collect()] == ["1"] and [r.geonameid for r in retrieval.adm1_by_name(q(helena), ind, own).collect()] == ["2"]
    found = spark.createDataFrame([(1, 0, uk), (1, 1, helena)], "doc_id long, mention_id int, in_rel string")
    assert {tuple(r) for r in retrieval.parents(found, ind, own).collect()} == {(uk, "GBR", ""), (helena, "SHN", "SH")}


def test_search_order_filters_and_fallback(spark, gaz, index):
    q = lambda *x: spark.createDataFrame([(n,) for n in x], "query string")
    assert [r.geonameid for r in retrieval.phrase_search(q("Berlin"), index, gaz).orderBy("slot").collect()] == ["2950159", "4500771"]
    assert [r.geonameid for r in retrieval.phrase_search(q("Berlin"), index, gaz, 1).collect()] == ["2950159"]
    assert [r.geonameid for r in retrieval.phrase_search(q("Berlin"), index, gaz, known_country="USA").collect()] == ["4500771"]
    assert retrieval.phrase_search(q("Alexanderplatz"), index, gaz, limit_types=True).isEmpty()
    assert {r.geonameid for r in retrieval.search(q("Berlinn", "Spandau"), index, gaz).collect()} == {"2950159", "4500771", "9"}
    assert retrieval.fuzzy_search(q("Brln"), gaz, edits=1).isEmpty() and retrieval.fuzzy_search(q("Brln"), gaz, edits=2).count() == 2
    assert retrieval.country_by_name(q("Germany", "Atlantis"), index, gaz).select("geonameid").collect() == [Row(geonameid="2921044")]
    rows = spark.createDataFrame([("North Holland", "NLD"), ("North Holland", "DEU"), ("None", "NLD")], "query string, code3 string")
    assert [(r.query, r.geonameid) for r in retrieval.adm1_by_name(rows, index, gaz, countries=True).collect()] == [("North Holland", "2749879")]
    found = spark.createDataFrame([(1, 0, "Germany"), (1, 1, "New York"), (1, 2, ""), (1, 3, "Nowhere")], "doc_id long, mention_id int, in_rel string")
    assert {tuple(r) for r in retrieval.parents(found, index, gaz).collect()} == {("Germany", "DEU", ""), ("New York", "USA", "New York")}
    assert [r.code3 for r in retrieval.country_by_code(spark.createDataFrame([("DEU",), ("ZZZ",)], "code3 string"), gaz).collect()] == ["DEU"]
    assert [(r.geonameid, r.name) for r in retrieval.by_id(spark.createDataFrame([("9",), ("0",)], "geonameid string"), gaz).select("geonameid", "name").orderBy("geonameid").collect()] == [("0", None), ("9", "Spandau")]


def test_strict_candidates_ignore_limit_types(spark, gaz, index):
    found = spark.createDataFrame([(1, 0, "Alexanderplatz", "")], "doc_id long, mention_id int, search_name string, in_rel string")
    ids = lambda strict, **o: [r.geonameid for r in retrieval.candidates(found, index, gaz, fallback=False, strict=strict, limit_types=True, **o).collect()]
    assert ids(True) == ["6944049"] and ids(True, known_country="USA") == [] and ids(False) == []


def test_whole_job_has_production_values(spark, sf_dir, monkeypatch):
    made, real = [], queries.Geoparser
    monkeypatch.setattr(queries, "Geoparser", lambda *a, **o: made.append(real(*a, **o)) or made[-1])
    assert not queries.geoparse_documents(spark, sf_dir).isEmpty()
    assert made[0].max_choices == 100 and made[0].fallback


def test_extent(gaz):
    assert gazetteer.data_extent(None) == schemas.DataExtent.NA and gazetteer.data_extent(gaz) == schemas.DataExtent.ALL
    assert gazetteer.data_extent(gaz.where("country_code3 = 'NLD'")) == schemas.DataExtent.TEST and gazetteer.data_extent(gaz.limit(0)) == schemas.DataExtent.NONE
    assert gazetteer.describe_extent(gaz)[1] == "a full gazetteer"


def test_coherence_shares(spark):
    cols = "doc_id long, mention_id int, geonameid string, country_code3 string, admin1_name string"
    rows = spark.createDataFrame([(1, 0, "a", "USA", "MA"), (1, 0, "b", "GBR", "England"), (1, 1, "c", "USA", "MA"), (1, 2, "d", "USA", "MA"), (1, 2, "NULL", "NULL", "NULL"), (1, 2, "e", "USA", "")], cols)
    got = {r.geonameid: (r.adm1_count, r.country_count) for r in features.coherence(rows).collect()}
    assert got["a"] == (1.0, 1.0) and abs(got["b"][0] - 1 / 3) < 1e-9 and got["NULL"] == (0, 0) and got["e"] == (0, 1.0)
    strict = {r.geonameid: r.adm1_count for r in features.coherence(rows, True).collect()}
    assert abs(strict["NULL"] - 1 / 3) < 1e-9 and abs(strict["e"] - 1 / 3) < 1e-9


def slot_rows(spark, k):
    rows = [(1, 0, i, "PPL", "DEU", *(0.5,) * 9, f"g{i}") for i in range(k)]
    return spark.createDataFrame(rows, "doc_id long, mention_id int, slot int, feature_code string, country_code3 string, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", geonameid string")


@pytest.mark.parametrize("k", [0, 2, 3, 4])
def test_slot_geometry(spark, k):
    """Four slots: room for padding, the row for no entry in the last slot, a candidate in the last slot."""
    only = spark.createDataFrame([(1, 0)], "doc_id long, mention_id int")
    rows = features.with_null_candidate(slot_rows(spark, k), only)
    assert rows.count() == k + 1 and rows.orderBy(F.col("slot").desc()).first().geonameid == "NULL"
    codes = spark.createDataFrame([("PPL", 0), ("NULL", 52)], "feature_code string, idx int")
    countries = spark.createDataFrame([("DEU", 0), ("NULL", 1), ("NA", 2)], "code3 string, idx int")
    slots = features.packed(features.coded(rows, codes, countries), 4, 1, ("geonameid",)).orderBy("slot").collect()
    assert [r.slot for r in slots] == [0, 1, 2, 3]
    assert [r.real for r in slots] == [i <= k for i in range(4)]
    assert slots[3].code_idx == 53 and slots[3].features == [-1.0] * 9
    if k == 2:
        assert slots[2].place.geonameid == "NULL" and slots[2].code_idx == 52 and slots[2].country_idx == 1
    if k == 0:
        assert slots[1].features == [99.0] * 5 + [0.0] * 4 and slots[1].place is None


def test_gold_candidates(spark):
    rows = slot_rows(spark, 3).withColumn("gold_id", F.lit("g1"))
    assert [r.is_correct for r in features.correct(rows).orderBy("slot").collect()] == [False, True, False]
    assert features.without_gold(rows).count() == 2
    assert training.labels(features.correct(rows), 4).first().label == 1
    assert training.labels(features.correct(rows.withColumn("gold_id", F.lit(None).cast("string"))), 4).first()[2:] == (3, "NULL")


def test_neural_forward_by_hand():
    """With zero layers but for one path, the output is a softmax of what that path passes on."""
    w = {k: np.zeros_like(v) for k, v in scoring.random_weights(2, bert=3, country=2, code=2, mix=2).items()}
    w["text_country_w"][0, 0] = w["country_w"][0, 0] = 1.0
    w["country_emb"][:] = [[1, 0, 0], [-1, 0, 0]]
    w["mix1_w"][0, 0] = w["mix2_w"][0, 0] = w["last_w"][0, 0] = 1.0
    place_, other = np.array([[2.0, 0, 0]]), np.zeros((1, 3))
    score, head = scoring.forward(w, place_, other, other, np.array([[0, 1]]), np.array([[0, 1]]), np.zeros((1, 2, 9)))
    sig = lambda x: 1 / (1 + np.exp(-x))
    logits = np.array([sig(sig(1.0)), sig(sig(-1.0))])
    assert np.allclose(score[0], np.exp(logits) / np.exp(logits).sum()) and np.allclose(head, 0.5)


def test_neural_scores_by_group(spark):
    slots = spark.createDataFrame([(1, 0, s, s, 0, [0.1 * s] * 9) for s in (1, 0, 2)] + [(1, 1, 0, 5, 1, [0.0] * 9)], "doc_id long, mention_id int, slot int, code_idx int, country_idx int, features array<double>")
    vectors = spark.createDataFrame([(1, m, [1.0] * 4, [0.5] * 4, [0.2] * 4) for m in (0, 1)], "doc_id long, mention_id int, tensor array<double>, doc_tensor array<double>, locs_tensor array<double>")
    w = scoring.random_weights(2, bert=4)
    got = {(r.mention_id, r.slot): r.score for r in scoring.neural_scores(slots, vectors, w).collect()}
    want, _ = scoring.forward(w, np.ones((1, 4)), np.full((1, 4), 0.2), np.full((1, 4), 0.5), np.array([[0, 1, 2]]), np.zeros((1, 3), int), np.array([[[0.0] * 9, [0.1] * 9, [0.2] * 9]]))
    assert np.allclose([got[0, i] for i in range(3)], want[0]) and got[1, 0] == 1.0


def test_city_rules(spark, gaz):
    up = spark.createDataFrame([("7", "2950159"), ("6944049", "2921044")], "child_id string, parent_id string")
    got = {r.geonameid: (r.city_id, r.city_name) for r in resolve.with_city(gaz, gaz, up).collect()}
    assert got["7"] == ("2950159", "Berlin") and got["6944049"] == ("", "") and got["2950159"] == ("2950159", "Berlin") and got["2921044"] == ("", "") and got["8"] == ("8", "Lone Section")
    strict = {r.geonameid: (r.city_id, r.city_name) for r in resolve.with_city(gaz, gaz, up, True).collect()}
    assert strict["8"] == ("Lone Section", "8")
    lost = spark.createDataFrame([("7", "gone")], "child_id string, parent_id string")
    assert {r.geonameid: r.city_id for r in resolve.with_city(gaz, gaz, lost).collect()}["7"] == ""


def test_first_n(spark):
    assert resolve.first_n(spark.range(5), -1).count() == 5 and resolve.first_n(spark.range(5), 2).count() == 2


def test_taggers_are_loaded_once_and_checked():
    made = []
    tag = mentions.LoadedTagger(lambda: made.append(1) or mentions.DictionaryTagger(["Berlin"]))
    assert [len(tag(mentions.tokenise(t))) for t in ("Berlin", "Paris", "In Berlin")] == [1, 0, 1] and made == [1]
    mentions.check_tagger(tag)
    for bad in (None, mentions.LoadedTagger(lambda: 1 / 0), lambda tokens: [(0, 99, "GPE")], lambda tokens: [("x",)]):
        with pytest.raises(ValueError):
            mentions.check_tagger(bad)
    with pytest.raises(ValueError):
        Geoparser(None, None, lambda tokens: [(5, 2, "GPE")])


def test_tables_are_looked_at(spark, gaz, index, tmp_path):
    assert gazetteer.missing({"a": gaz, "b": gaz.limit(0), "c": None}) == ["b", "c"]
    with pytest.raises(ValueError):
        Geoparser(gaz, index.limit(0), mentions.DictionaryTagger(["Berlin"])).check()
    gaz.write.parquet(str(tmp_path / "g"))
    gaz.createOrReplaceTempView("some_places")
    assert gazetteer.table_exists(spark, str(tmp_path / "g")) and not gazetteer.table_exists(spark, str(tmp_path / "h")) and gazetteer.table_exists(spark, "some_places") and not gazetteer.table_exists(spark, "no_places")


def test_country_head(spark):
    w = scoring.random_weights(3, bert=4)
    rows = spark.createDataFrame([(1, 0, [1.0, 0.5, -1.0, 2.0])], "doc_id long, mention_id int, tensor array<double>")
    got = scoring.country_scores(rows, w).first().countries
    want = scoring.forward(w, np.array([[1.0, 0.5, -1.0, 2.0]]), np.zeros((1, 4)), np.zeros((1, 4)), np.zeros((1, 1), int), np.zeros((1, 1), int), np.zeros((1, 1, 9)))[1][0]
    assert np.allclose(got, want) and abs(sum(got) - 1) < 1e-9


@pytest.mark.parametrize("k", [0, 1, 5, 6, 7, 8, 11])
@pytest.mark.parametrize("strict", [False, True])
def test_arrays_decide_as_packed_slots_do(spark, k, strict):
    """Eight slots, with fewer candidates, just as many, and more."""
    rng = np.random.default_rng(k)
    rows = [(1, m, s, f"g{s}", "A" if s % 2 else "B", f"p{s % 3}", *map(float, rng.integers(0, 4, 9) / 4)) for m in range(6) for s in range(k if m else max(0, k - 1))]
    cols = "doc_id long, mention_id int, slot int, geonameid string, country_code3 string, admin1_name string, " + ", ".join(f"{c} double" for c in features.FEATURES)
    df, only = spark.createDataFrame(rows, cols), spark.createDataFrame([(1, m) for m in range(7)], "doc_id long, mention_id int")
    packed_ = features.with_null_candidate(df, only).withColumns({"code_idx": F.lit(1), "country_idx": F.lit(1)})
    packed_ = packed_.withColumns({c: F.when(F.col("geonameid") == "NULL", float(strict)).otherwise(F.col(c)) for c in ("adm1_count", "country_count")})
    for weights in (scoring.WEIGHTS, tuple(-x / 50 for x in scoring.WEIGHTS), (0.0,) * 9):
        plain = scoring.linear_scores(features.packed(packed_, 8, 0, ("geonameid",)), weights).withColumn("score", F.round("score", 9))
        for n in (1, 3):
            want = resolve.resolve(plain, 8, n, strict).select("mention_id", "rank", "slot", "score", "place.geonameid", "reason")
            got = resolve.resolve_arrays(slots.scored(features.with_mentions(df, only), 8, weights, ("geonameid",), 9, strict), n, strict).select("mention_id", "rank", "slot", "score", "place.geonameid", "reason")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def parser(spark, gaz, index):
    up = spark.createDataFrame([("7", "2950159")], "child_id string, parent_id string")
    return Geoparser(gaz, index, mentions.DictionaryTagger(["Berlin", "Germany", "Alexanderplatz", "Mitte", "Atlantis", "New York"]), up, max_choices=10, fallback=False, weights=(0.5, 0, 0, -0.01, -0.01, 1, 1, 1, 3))


def test_geoparse(spark, parser):
    docs = spark.createDataFrame([(1, "I saw Berlin in Germany."), (2, "Nothing here."), (3, "Atlantis sank."), (4, "I saw Berlin in Germany."), (5, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.mention_id): r for r in parser.resolved(docs).collect()}
    assert rows[1, 0].geonameid == "2950159" and rows[1, 0].country_code3 == "DEU" and rows[1, 0].city_name == "Berlin" and (rows[1, 0].start_char, rows[1, 0].end_char) == (6, 12)
    assert rows[1, 1].geonameid == "2921044" and rows[1, 0].reason == "" and {k[0] for k in rows} == {1, 3, 4}
    assert rows[3, 0].geonameid is None and rows[3, 0].reason and rows[4, 0][2:] == rows[1, 0][2:]
    assert "min_dist" not in rows[1, 0].asDict() and "min_dist" in parser.resolved(docs, trim=False).columns
    out = {r.doc_id: r for r in parser.documents(docs).collect()}
    assert len(out) == 5 and out[2].geolocated_ents == [] and [x.search_name for x in out[1].geolocated_ents] == ["Berlin", "Germany"]
    assert {r.geonameid for r in parser.resolved(docs, known_country="USA").where("doc_id = 1 AND mention_id = 0").collect()} <= {"4500771", None}
    assert parser.resolved(docs, top_n=3).where("doc_id = 1 AND mention_id = 0").count() == 3
    eleven = resolve.extracted(parser.resolved(docs)).where("doc_id = 1").orderBy("start_char").collect()
    assert [(r.extracted_name, r.geonameid, r.start_char, r.end_char) for r in eleven] == [("Berlin", "2950159", 6, 12), ("Germany", "2921044", 16, 23)] and len(eleven[0]) == 12


def test_ids_that_repeat_and_null_ids(spark, parser):
    docs = spark.createDataFrame([(1, "Berlin here"), (1, "New York there"), (2, "Berlin here"), (None, "Berlin here"), (3, "Berlin here"), (3, "Berlin here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.mention_id, r.search_name) for r in parser.mentions(docs).collect())
    by_key = ["Berlin", "New York"] if parser.mentions(docs).where("doc_id = 1 AND mention_id = 0").first().search_name == "Berlin" else ["New York", "Berlin"]
    assert got == [*((1, k, x) for k, x in enumerate(by_key)), (2, 0, "Berlin"), (3, 0, "Berlin")]
    assert sorted((r.doc_id, r.search_name) for r in parser.resolved(docs).collect()) == [(1, "Berlin"), (1, "New York"), (2, "Berlin"), (3, "Berlin")]


def test_plan_of_the_job(spark, gaz, parser, monkeypatch):
    """After retrieval one exchange by document serves features, coherence and decision, and no slot is a row."""
    found = spark.createDataFrame([(1, 0, "Berlin", 0, 6, "GPE", 0, "")], schemas.MENTION)
    plan = parser.decided(found)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("hashpartitioning(doc_id")]
    assert "Exchange" not in last.rsplit("\n", 1)[0] and plan.count("REPARTITION_BY_COL") == 1 and "Generate explode(sequence" not in plan


def test_neural_geoparse(spark, gaz, index):
    codes = spark.createDataFrame([("PPL", 0), ("PCLI", 1)], "feature_code string, idx int")
    countries = spark.createDataFrame([("DEU", 0), ("USA", 1), ("NLD", 2), ("NULL", 3), ("NA", 4)], "code3 string, idx int")
    p = Geoparser(gaz, index, mentions.DictionaryTagger(["Berlin"]), None, codes, countries, scoring.random_weights(5, bert=4), 6, fallback=False)
    docs = spark.createDataFrame([(1, "Berlin is big.")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0] * 4, [0.5] * 4, [0.2] * 4)], "doc_id long, mention_id int, tensor array<double>, doc_tensor array<double>, locs_tensor array<double>")
    assert p.resolved(docs, vectors=vectors).count() == 1


def test_event_job(spark, parser):
    story = [("Head", "Protest in Berlin today. Later in New York.", 1, [(10, "Protest in Berlin today.", "Protest", 0), (11, "absent text", "Riot", 0)])]
    stories = spark.createDataFrame(story, schemas.STORY)
    info = spark.createDataFrame([("DEU", "Germany")], "code3 string, name string")

    def answerer(questions, contexts):
        return [(c.find("Berlin"), c.find("Berlin") + 6, "Berlin") for c in contexts]

    rows = {r.event_id: r for r in parser.events(stories, answerer, info, limit=1).collect()}
    assert rows[10].extracted_name == "Berlin" and rows[10].sentence_num == 0 and rows[10].partial_doc == "Head\nProtest in Berlin today."
    assert parser.events(stories, answerer, info, limit=0).count() == 0 and parser.events(readers.story_events(stories), answerer, info).count() == 2
    assert rows[10].place == "Berlin" and rows[10].country == "Germany" and rows[10].event_loc_reason == events.REASONS["match"] and rows[11].qa_answer == "Berlin"


def test_evaluation_counts_missing(spark):
    cols = "doc_id long, mention_id int, slot int, score double, is_correct boolean, geonameid string, country_code3 string, feature_code string, admin1_code string, lat double, lon double"
    g = lambda d, s, score, ok, gid, lat=0.0: (d, 0, s, score, ok, gid, "A", "PPL", "1", lat, 0.0)
    rows = spark.createDataFrame([g(1, 0, 0.9, True, "a"), g(1, 1, 0.1, False, "n"), g(2, 0, 0.2, True, "b"), g(2, 1, 0.7, False, "c", 1.0), g(2, 2, 0.1, False, "n"), g(3, 0, 0.1, False, "d"), g(3, 1, 0.9, False, "n"), g(4, 0, 0.9, False, "e"), g(4, 1, 0.1, False, "n")], cols)
    r = evaluate.evaluate(rows).first()
    assert (r.mentions, r.exact_match, r.missing_correct, r.total_missing, r.acc_at_161) == (4, 0.5, 0.5, 0.5, 1.0) and abs(r.avg_dist - 55.6) < 0.1
    assert evaluate.missing_at(rows, 1).first().missing_share == 0.5


@pytest.mark.parametrize("seed", range(3))
def test_median_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, v) for k, n in (("a", 101), ("b", 100), (None, 7), ("one", 1), ("two", 2)) for v in rng.choice([0.0, 0.0, 0.25, 3.5, *(20_000 * rng.random(40))], n).tolist()] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert {r.k: r["median"] for r in evaluate.median(df, "v", "k").collect()} == want
    assert evaluate.median(df, "v").first()["median"] == df.agg(F.median("v")).first()[0]
    assert evaluate.median(df.limit(0), "v", "k").count() == 0


def test_training_parts(spark):
    head, tail = training.head_tail(spark.range(10), 0.35, "id")
    assert head.count() == 4 and tail.count() == 6
    shuffled = spark.range(1000, numPartitions=7).selectExpr("(id * 7919) % 1000 as id")
    assert [(r.row_number, r.id) for r in training.numbered(shuffled, "id").orderBy("row_number").collect()] == [(i, i) for i in range(1000)]
    head, tail = training.head_tail(shuffled, 0.3, "id")
    assert {r.id for r in head.collect()} == set(range(300)) and tail.count() == 700 and training.numbered(spark.range(0), "id").count() == 0
    assert training.shuffled(spark.range(20), "id", 1).collect() == training.shuffled(spark.range(20), "id", 1).collect() and training.shuffled(spark.range(20), "id", n=3).count() == 3
    assert training.sound(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "tensor array<double>")).count() == 1
    sent = spark.createDataFrame([("t", 1, 2, 7)], "text string, start_char_sent int, end_char_sent int, correct_geonamesid long")
    assert training.from_sentences(sent).first() == Row(text="t", start=1, end=2, gold_id="7")
    assert training.labelled_only(spark.createDataFrame([("a",), (None,)], "gold_id string")).count() == 1
    rng = np.random.default_rng(0)
    rows = [(1, m, bool(s == 0), *(float(x) for x in (rng.normal(2.0 if s == 0 else 0.0, 1.0), *rng.normal(size=8)))) for m in range(60) for s in range(3)]
    w = training.fit_linear(spark.createDataFrame(rows, "doc_id long, mention_id int, is_correct boolean, " + ", ".join(f"{c} double" for c in features.FEATURES)), rounds=8)
    assert w[0] == max(w) and w[0] > 0.3


def test_stream(spark, parser, tmp_path):
    spark.createDataFrame([(1, "I saw Berlin in Germany.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        resolve_stream(source, parser, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.geonameid for r in spark.read.parquet(str(tmp_path / "out")).orderBy("mention_id").collect()] == ["2950159", "2921044"]


def test_split_mark_rounds_decimals_and_puts_nulls_last(spark):
    for n in (5, 45, 85, 182_675):
        rows = spark.range(n).selectExpr("id", "'a' AS part")
        assert training.split_mark(rows, 0.7, "id", "part").where("is_train").count() == (7 * n + 5) // 10
    rows = spark.range(45).selectExpr("nullif(id, 3) AS id", "'a' AS part")
    got = {r.id: r.is_train for r in training.split_mark(rows, 0.7, "id", "part").collect()}
    assert got == {i: i <= 32 for i in range(45) if i != 3} | {None: False}


def test_geoparse_without_a_stored_index(spark, gaz, parser):
    """The gazetteer scanned for what is asked gives what an index gives, also for misspelt names, parents and mentions without an entry, and its plans move no entry that is not asked for."""
    docs = spark.createDataFrame([(1, "I saw Berlin in Germany. Then Homs, Syria was next."), (2, "Berlim and Aleppo and Nowhereville."), (3, None), (3, "Berlin")], "doc_id long, text string")
    plain = Geoparser(gaz, gazetteer.ranked_index(gaz), mentions.DictionaryTagger(["Berlin", "Germany", "Homs", "Syria", "Berlim", "Aleppo", "Nowhereville"]))
    scan = Geoparser(gaz, None, plain.tagger)
    scan.check()
    want = sorted(map(str, plain.resolved(docs).collect()))
    assert len(want) == 8 and sorted(map(str, scan.resolved(docs).collect())) == want
    key = ("doc_id", "mention_id", "slot")
    found = [sorted(map(str, p.candidates(p.mentions(docs)).select(*key, *sorted({"geonameid", "name", *features.FEATURES})).collect())) for p in (plain, scan)]
    assert found[0] == found[1]
    assert gazetteer.ranked_index(gaz, spark.createDataFrame([("berlin",)], "phrase string")).exceptAll(plain.index.where("phrase = 'berlin'")).isEmpty()

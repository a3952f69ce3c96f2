"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.functions import math as fm
from geolith.functions import text as fx
from geolith.operators import evaluate as evl
from geolith.operators import events as ev
from geolith.operators import features as ft
from geolith.operators import gazetteer as gz
from geolith.operators import mentions as mn
from geolith.operators import resolve as rs
from geolith.operators import retrieval as rt
from geolith.operators import scoring as sc
from geolith.operators import slots as sl
from geolith.operators import training as tr
from geolith.plans import demo, large
from geolith.plans.geoparse import Geoparser
from geolith.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Candidates of each mention, and slots, in the registered queries.
K, SLOTS = 6, 8


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- gazetteer and sources

_RAW = (
    "('6252001', 'United States', 'United States', '', '39.76', '-98.5', 'A', 'PCLI', 'US', '00', '', '327167434', 1), ('239880', 'Central African Republic', 'Central African Republic', 'CAR,Centrafrique,CAR', '7.0', '21.0', 'A', 'PCLI', 'CF', '', '', '4666377', 2), "
    "('2950159', 'Berlin', 'Berlin', 'Berlim,Berlin', '52.52437', '13.41053', 'P', 'PPLC', 'DE', '16', '00', '3426354', 3), ('2749879', 'Provincie Noord-Holland', 'Provincie Noord-Holland', 'North Holland', '52.58333', '4.91667', 'A', 'ADM1', 'NL', '07', '', '2877909', 4), "
    "('7290718', 'Barra da Tijuca', 'Barra da Tijuca', '', '-22.99835', '-43.36545', 'P', 'PPL', 'BR', '21', '3304557', '', 5), ('1', 'Nowhere', 'Nowhere', 'a,b,a', '1', '2', 'P', 'PPL', 'ZZ', '9', '9', 'x', 6), ('2', 'Bad', 'Bad', '', 'north', '2', 'P', 'PPL', 'DE', '', '', '0', 7)"
)
_RAW_COLUMNS = "geonameid, name, asciiname, alternates, lat, lon, feature_class, feature_code, iso2, admin1_code, admin2_code, population, line"
_ISO = "('US', 'USA'), ('CF', 'CAF'), ('DE', 'DEU'), ('NL', 'NLD'), ('BR', 'BRA')"
_ADM1 = "('DE.16', 'Berlin'), ('NL.07', 'North Holland'), ('BR.21', 'Rio de Janeiro')"
_ADM2 = "('BR.21.3304557', 'Rio de Janeiro'), ('DE.16.00', 'Berlin, Stadt')"


@_query(f"""WITH raw({_RAW_COLUMNS}) AS (VALUES {_RAW}), iso(iso2, code3) AS (VALUES {_ISO}), a1(code, name) AS (VALUES {_ADM1}), a2(code, name) AS (VALUES {_ADM2}),
alts AS (SELECT *, list_distinct(string_split(alternates, ',')) AS l FROM raw WHERE try_cast(lat AS DOUBLE) IS NOT NULL AND try_cast(lon AS DOUBLE) IS NOT NULL),
more AS (SELECT *, CASE geonameid WHEN '6252001' THEN list_concat(l, ['US', 'U.S.']) WHEN '239880' THEN list_concat(l, ['C.A.R.']) ELSE l END AS names FROM alts)
SELECT geonameid, m.name, array_to_string(list_sort(names), '|') AS alternativenames, len(names)::INT AS alt_name_length, lat::DOUBLE AS lat, lon::DOUBLE AS lon, feature_code, coalesce(code3, 'NA') AS country_code3,
  coalesce(a1.name, '') AS admin1_name, coalesce(a2.name, '') AS admin2_name, coalesce(try_cast(population AS BIGINT), 0) AS population
FROM more m LEFT JOIN iso USING (iso2) LEFT JOIN a1 ON a1.code = iso2 || '.' || admin1_code LEFT JOIN a2 ON a2.code = iso2 || '.' || admin1_code || '.' || admin2_code""")
def gazetteer_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = demo.literal(spark, _RAW, _RAW_COLUMNS).withColumns({"admin3_code": F.lit(""), "admin4_code": F.lit(""), "valid": F.col("lat").try_cast("double").isNotNull() & F.col("lon").try_cast("double").isNotNull()})
    iso, a1, a2 = (demo.literal(spark, v, c) for v, c in ((_ISO, "iso2, code3"), (_ADM1, "code, name"), (_ADM2, "code, name")))
    out = gz.build_gazetteer(raw, iso, a1, a2)
    return out.select("geonameid", "name", F.array_join(F.array_sort("alternativenames"), "|").alias("alternativenames"), "alt_name_length", "lat", "lon", "feature_code", "country_code3", "admin1_name", "admin2_name", "population")


@_query(_with(demo.GAZETTEER) + "SELECT geonameid, name, array_to_string(list_sort(alternativenames), '|') AS alternativenames, round(lat, 6) AS lat, round(lon, 6) AS lon, feature_class, feature_code, country_code3, admin1_code, admin1_name, population, alt_name_length FROM gaz")
def gazetteer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir).withColumn("alternativenames", F.array_join(F.array_sort("alternativenames"), "|"))
    return _rounded(g.select("geonameid", "name", "alternativenames", "lat", "lon", "feature_class", "feature_code", "country_code3", "admin1_code", "admin1_name", "population", "alt_name_length"), "lat", "lon")


@_query(_with(demo.GAZETTEER) + """, t AS (SELECT geonameid, string_split(trim(n), ' ') AS w FROM gnames), r AS (SELECT geonameid, w, unnest(range(1, len(w) + 1)) AS i FROM t), q AS (SELECT geonameid, w, i, unnest(range(i, len(w) + 1)) AS j FROM r)
SELECT DISTINCT array_to_string(w[i:j], ' ') AS phrase, geonameid FROM q""")
def phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gz.phrase_index(demo.gazetteer(spark, sf_dir))


_UP = "('a', 'x', 1), ('b', 'x', 2), ('c', 'y', 3), (NULL, 'z', 4), ('d', 'y', 5), ('a', '', 6)"


@_query(f"WITH t(parent_id, child_id, place) AS (VALUES {_UP}) SELECT child_id, arg_max(parent_id, place) AS parent_id FROM t WHERE coalesce(child_id, '') <> '' AND parent_id IS NOT NULL GROUP BY child_id")
def hierarchy_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.last_parents(demo.literal(spark, _UP, "parent_id, child_id, place"))


@_query("""SELECT c_nationkey, arg_max(c_custkey, c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey""")
def upsert_last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return sinks.last_by_id(c.withColumn("o", F.col("c_custkey")), "o", "c_nationkey").select("c_nationkey", "c_custkey", "c_name")


@_query("WITH e AS (SELECT event_id, event_type, props FROM events) SELECT event_id, event_type, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM e)")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.read(spark, sf_dir, "events").select("event_id", "event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e


_EXTENT = "('New York', 'New York', 'A', 'ADM1', 'USA'), ('Provincie Noord-Holland', 'North Holland', 'A', 'ADM1', 'NLD')"


@_query(f"""WITH g(name, asciiname, feature_class, feature_code, country_code3) AS (VALUES {_EXTENT}), c(case_name, code) AS (VALUES ('both', '%'), ('nld', 'NLD'), ('usa', 'USA'), ('none', '')),
h AS (SELECT case_name, bool_or(country_code3 = 'USA' AND 'New York' IN (name, asciiname)) AS usa, bool_or(country_code3 = 'NLD' AND 'North Holland' IN (name, asciiname)) AS nld FROM c LEFT JOIN g ON country_code3 LIKE code GROUP BY 1)
SELECT case_name, CASE WHEN usa AND nld THEN 3 WHEN nld THEN 2 ELSE 1 END AS extent FROM h""")
def data_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.literal(spark, _EXTENT, "name, asciiname, feature_class, feature_code, country_code3").withColumn("alternativenames", F.array("asciiname"))
    cases = {"both": rows, "nld": rows.where("country_code3 = 'NLD'"), "usa": rows.where("country_code3 = 'USA'"), "none": rows.limit(0)}
    return spark.createDataFrame([(k, int(gz.data_extent(v))) for k, v in cases.items()], "case_name string, extent int")


# ---- text


@_query(_with(demo.PIECES) + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, piece, start FROM pcs WHERE regexp_matches(piece, '^\\p{L}')")
def tokenise_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.pieces(demo.read(spark, sf_dir, "documents"))


def _cleaned(rules: list[str]) -> str:
    x = "name"
    for r in rules:
        x = f"trim(regexp_replace({x}, '{r.replace(chr(39), chr(39) * 2)}', '', 'g'))"
    return f"CASE WHEN {x} = 'US' THEN 'United States' ELSE {x} END"


@_query(f"WITH t(name) AS (VALUES {demo.PLACES}) SELECT name, {_cleaned(fx.STRICT_RULES)} AS strict, {_cleaned(fx.FIXED_RULES)} AS fixed FROM t")
def clean_search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.literal(spark, demo.PLACES, "name").select("name", fx.clean_search_name(F.col("name"), True).alias("strict"), fx.clean_search_name(F.col("name")).alias("fixed"))


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + "SELECT doc_id, mention_id, search_name, start_char, end_char FROM men")
def mention_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.mentions(spark, sf_dir).drop("in_rel")


_REL = "(1, 'I visited Paris, France.'), (2, 'I visited Paris, Berlin, and Munich.'), (3, 'Paris, France'), (4, 'He lives in Paris in France now.'), (5, 'Paris and Berlin.'), (6, 'Paris. France is big.'), (7, 'From Paris to Berlin in Germany.'), (8, ''), (9, 'Paris France, Berlin.')"
_REL_NAMES = ["Paris", "France", "Berlin", "Munich", "Germany"]


@_query("""WITH t(doc_id, mention_id, search_name, start_char, end_char, in_rel, strict_rel) AS (VALUES (1, 0, 'Paris', 10, 15, 'France', 'France'), (1, 1, 'France', 17, 23, '', ''), (2, 0, 'Paris', 10, 15, '', ''), (2, 1, 'Berlin', 17, 23, '', ''), (2, 2, 'Munich', 29, 35, '', ''),
 (3, 0, 'Paris', 0, 5, 'France', ''), (3, 1, 'France', 7, 13, '', ''), (4, 0, 'Paris', 12, 17, 'France', 'France'), (4, 1, 'France', 21, 27, '', ''), (5, 0, 'Paris', 0, 5, '', ''), (5, 1, 'Berlin', 10, 16, '', ''), (6, 0, 'Paris', 0, 5, '', ''), (6, 1, 'France', 7, 13, '', ''),
 (7, 0, 'Paris', 5, 10, '', ''), (7, 1, 'Berlin', 14, 20, 'Germany', 'Germany'), (7, 2, 'Germany', 24, 31, '', ''), (9, 0, 'Paris', 0, 5, 'Berlin', 'Berlin'), (9, 1, 'France', 6, 12, 'Berlin', 'Berlin'), (9, 2, 'Berlin', 14, 20, '', ''))
SELECT doc_id::BIGINT AS doc_id, mention_id, search_name, start_char, end_char, in_rel, strict_rel FROM t""")
def in_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tag = demo.literal(spark, _REL, "doc_id, text"), mn.DictionaryTagger(_REL_NAMES)
    strict = mn.extract_mentions(docs, tag, True).select("doc_id", "mention_id", F.col("in_rel").alias("strict_rel"))
    return mn.extract_mentions(docs, tag).join(strict, ["doc_id", "mention_id"]).select("doc_id", "mention_id", "search_name", "start_char", "end_char", "in_rel", "strict_rel")


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + "SELECT doc_id, count(*) AS n_mentions FROM men GROUP BY doc_id")
def dedup_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each distinct text once, given to all documents of that text."""
    names = demo.gazetteer(spark, sf_dir).select("asciiname").distinct()
    stage = lambda docs: mn.pieces(docs, "text_key", "string").join(names, F.col("piece") == F.col("asciiname"))
    return mn.once_per_text(demo.read(spark, sf_dir, "documents"), stage).groupBy("doc_id").agg(F.count("*").alias("n_mentions"))


_ODD_DOCS = "(1, 'Paris here'), (1, 'Berlin there'), (2, 'Paris here'), (CAST(NULL AS INT), 'Paris here'), (3, 'Berlin and Paris'), (3, 'Berlin and Paris'), (4, CAST(NULL AS STRING)), (5, '')"


@_query(f"""WITH t(doc_id, text) AS (VALUES {_ODD_DOCS.replace("STRING", "VARCHAR")}), d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM t), w AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS name FROM d)
SELECT doc_id::BIGINT AS doc_id, name AS search_name, position(name IN text)::INT - 1 AS start_char FROM w WHERE name IN ('Paris', 'Berlin')""")
def once_per_text_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat under other ids, ids that repeat with other texts, null ids and texts."""
    docs, tag = demo.literal(spark, _ODD_DOCS, "doc_id, text").withColumn("doc_id", F.col("doc_id").cast("long")), mn.DictionaryTagger(["Paris", "Berlin"])
    return mn.once_per_text(docs, lambda once: mn.extract_mentions(once, tag, key="text_key", kind="string")).select("doc_id", "search_name", "start_char")


_LONG_NAMES = "('1', 'United Kingdom of Great Britain and Northern Ireland', 9), ('2', 'Saint Helena, Ascension and Tristan da Cunha', 3), ('3', 'South Georgia and the South Sandwich Islands', 4), ('4', 'Islands', 2), ('5', 'Great Britain', 7)"
_LONG_QUERIES = "('United Kingdom of Great Britain and Northern Ireland'), ('Saint Helena, Ascension and Tristan da Cunha'), ('Georgia and the South Sandwich Islands'), ('Great Britain and Northern Ireland'), ('United Kingdom of Little Britain and Northern Ireland'), ('great britain'), ('Islands')"


@_query(f"""WITH g(geonameid, name, alt_name_length) AS (VALUES {_LONG_NAMES}), q(query) AS (VALUES {_LONG_QUERIES}),
h AS (SELECT query, geonameid, alt_name_length FROM q JOIN g ON contains(' ' || trim(regexp_replace(lower(name), '[^a-z]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(query), '[^a-z]+', ' ', 'g')) || ' '))
SELECT query, (row_number() OVER (PARTITION BY query ORDER BY alt_name_length DESC, geonameid) - 1)::INT AS slot, geonameid FROM h""")
def phrase_search_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of seven words and more, found whole and by parts, through the plain and the ranked index."""
    rows = demo.literal(spark, _LONG_NAMES, "geonameid, name, alt_name_length").withColumns({"asciiname": F.col("name"), "alternativenames": F.array().cast("array<string>"), "country_code3": F.lit("X"), "feature_class": F.lit("P")})
    asked = demo.literal(spark, _LONG_QUERIES, "query")
    plain, ranked = rt.phrase_search(asked, gz.phrase_index(rows), rows), rt.phrase_search(asked, gz.ranked_index(rows), rows)
    return plain.intersect(ranked)


@_query()
def dictionary_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagger with names of several words. Names are a parameter of the tagger and few here: those of the gazetteer that has three a word of the benchmark."""
    names = [r.name for r in demo.gazetteer(spark, sf_dir).select("name").distinct().collect()]
    return mn.extract_mentions(demo.read(spark, sf_dir, "documents"), mn.DictionaryTagger(names))


@_query("SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(w, [strip_accents(x) for x in w]))), '|') AS names FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def accent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = demo.read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("names"))
    return words.select("item_id", F.array_join(F.array_sort(fx.expand_accents(F.col("names"))), "|").alias("names"))


_PARTIAL = "(1, 'a b. c b. d', 'b.'), (2, 'no event here', 'x'), (3, 'same', 'same'), (4, 'two. two. end', 'two.'), (5, 'abc', '')"


@_query(f"WITH t(id, body, event) AS (VALUES {_PARTIAL}) SELECT id, CASE WHEN event <> '' AND contains(body, event) THEN substr(body, 1, length(body) - position(reverse(event) IN reverse(body)) + 1) END AS partial_doc FROM t")
def event_partial_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.literal(spark, _PARTIAL, "id, body, event").select("id", fx.partial_text(F.col("body"), F.col("event")).alias("partial_doc"))


# ---- retrieval


def _found(spark: SparkSession, sf_dir: str, k: int = K, **only: object) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.phrase_search(demo.names(spark, sf_dir), gz.phrase_index(g), g, k, **only)


def _search(where: str = "") -> str:
    return _with(demo.GAZETTEER, demo.NAMES, demo.SEARCH.format(more="", names="names", where=where)) + f"SELECT query, slot::INT AS slot, geonameid FROM hits WHERE slot < {K}"


@_query(_search())
def phrase_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@_query(_search("WHERE country_code3 = 'DEU'"))
def known_country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, known_country="DEU")


@_query(_search("WHERE feature_class IN ('P', 'A')"))
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, limit_types=True)


_FUZZY = "words AS (SELECT DISTINCT geonameid, unnest(string_split(trim(n), ' ')) AS word FROM gnames), fh AS (SELECT DISTINCT query, w.geonameid, alt_name_length FROM {names} q JOIN words w ON list_bool_or([levenshtein(x, w.word) <= {n} for x in string_split(lower(query), ' ')]) JOIN gaz g ON g.geonameid = w.geonameid), fuzzy AS (SELECT query, geonameid, row_number() OVER (PARTITION BY query ORDER BY alt_name_length DESC, geonameid) - 1 AS slot FROM fh)"


@_query(_with(demo.GAZETTEER, "names AS (SELECT DISTINCT asciiname || 'q' AS query FROM gaz)", _FUZZY.format(names="names", n=2)) + f"SELECT query, slot::INT AS slot, geonameid FROM fuzzy WHERE slot < {K}")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.fuzzy_search(g.select(F.concat("asciiname", F.lit("q")).alias("query")), g, K, 2)


@_query(_with(demo.GAZETTEER, demo.NAMES, demo.SEARCH.format(more="", names="names", where=""), "rest AS (SELECT query FROM names WHERE query NOT IN (SELECT query FROM hits))", _FUZZY.format(names="rest", n=1))
        + f"SELECT query, slot::INT AS slot, geonameid FROM (SELECT query, slot, geonameid FROM hits UNION ALL SELECT query, slot, geonameid FROM fuzzy) WHERE slot < {K}")
def fuzzy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.search(demo.names(spark, sf_dir), gz.phrase_index(g), g, K)


def _first(code: str, at: str) -> str:
    """CTEs that end in {at}: the first entry of a feature code for each name."""
    return f"""{at}_hits AS (SELECT query, g.*, bool_or(trim(n.n) = trim(lower(query))) AS exact FROM names JOIN gnames n ON contains(n.n, ' ' || lower(query) || ' ') JOIN gaz g ON g.geonameid = n.geonameid AND feature_code = '{code}' GROUP BY ALL),
{at} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, alt_name_length DESC, population DESC, geonameid) AS r FROM {at}_hits) WHERE r = 1)"""


def _best(code: str) -> str:
    return _with(demo.GAZETTEER, demo.NAMES, _first(code, "best")) + "SELECT query, geonameid, country_code3, admin1_name FROM best"


@_query(_best("PCLI"))
def country_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.country_by_name(demo.names(spark, sf_dir), gz.phrase_index(g), g).select("query", "geonameid", "country_code3", "admin1_name")


@_query(_best("ADM1"))
def adm1_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.adm1_by_name(demo.names(spark, sf_dir), gz.phrase_index(g), g).select("query", "geonameid", "country_code3", "admin1_name")


@_query(_with(demo.GAZETTEER) + "SELECT code3, geonameid FROM (SELECT country_code3 AS code3, geonameid, row_number() OVER (PARTITION BY country_code3 ORDER BY geonameid) AS r FROM gaz WHERE feature_code = 'PCLI' AND country_code3 IN ('DEU', 'SYR')) WHERE r = 1")
def country_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.country_by_code(demo.literal(spark, "('DEU'), ('SYR'), ('XXX')", "code3"), demo.gazetteer(spark, sf_dir)).select("code3", "geonameid")


@_query(_with(demo.GAZETTEER, demo.NAMES, _first("PCLI", "c"), _first("ADM1", "a")) + """SELECT n.query AS in_rel, coalesce(c.country_code3, a.country_code3) AS parent_country, if(c.query IS NULL, a.admin1_name, '') AS parent_adm1
FROM names n LEFT JOIN c ON c.query = n.query LEFT JOIN a ON a.query = n.query WHERE c.query IS NOT NULL OR a.query IS NOT NULL""")
def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    return rt.parents(demo.names(spark, sf_dir).withColumnRenamed("query", "in_rel"), gz.phrase_index(g), g)


@_query("SELECT c_custkey, c_nationkey AS key, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return rt.by_id(c, demo.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geonameid"), "n_name"), "key").select("c_custkey", "key", "n_name")


@_query(_with(demo.GAZETTEER) + "SELECT geonameid, CASE country_code3 WHEN 'DEU' THEN 'Germany' WHEN 'NLD' THEN 'Netherlands' ELSE country_code3 END AS country_name FROM gaz")
def country_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = demo.literal(spark, "('DEU', 'Germany'), ('NLD', 'Netherlands')", "code3, name")
    return rt.country_names(demo.gazetteer(spark, sf_dir), info).select("geonameid", "country_name")


# ---- features, scores, decisions


def _candidates(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, candidates with gazetteer columns, gazetteer)."""
    g, m = demo.gazetteer(spark, sf_dir), demo.mentions(spark, sf_dir)
    found = rt.candidates(m, gz.phrase_index(g), g, k, fallback=False)
    rows = found.join(g.drop("admin3_code", "admin4_code", "modification_date", "alt_name_length"), "geonameid").drop("in_rel")
    return m, rows, g


def _cand(k: int = K) -> str:
    """CTEs up to cand: each mention's candidates."""
    return ",\n".join([demo.GAZETTEER, demo.MENTIONS, "mnames AS (SELECT DISTINCT search_name AS query FROM men)", demo.SEARCH.format(more="", names="mnames", where=""), f"cand AS (SELECT m.doc_id, m.mention_id, m.search_name, h.slot::INT AS slot, g.* FROM men m JOIN hits h ON h.query = m.search_name JOIN gaz g ON g.geonameid = h.geonameid WHERE slot < {k})"])


@_query("WITH " + _cand() + " SELECT doc_id, mention_id, slot, geonameid FROM cand")
def candidate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[1].select("doc_id", "mention_id", "slot", "geonameid")


_DIST = """dist AS (SELECT *, [levenshtein(search_name, x) for x in list_concat([name], alternativenames)] AS d FROM cand),
raw AS (SELECT *, list_min(d)::DOUBLE AS mn, list_max(d)::DOUBLE AS mx, list_avg(d) AS av, levenshtein(search_name, asciiname)::DOUBLE AS asc_, ln(len(alternativenames) + 1) AS al FROM dist),
feat AS (SELECT *, {}, 0 AS z FROM raw WINDOW w AS (PARTITION BY doc_id, mention_id))""".format(
    ", ".join(f"({c} - min({c}) OVER w) / if(max({c}) OVER w = 0, 0.001, max({c}) OVER w) AS {n}" for c, n in (("mn", "min_dist"), ("mx", "max_dist"), ("av", "avg_dist"), ("asc_", "ascii_dist"), ("al", "alt_name_log")))
)
_DISTS = ("min_dist", "max_dist", "avg_dist", "ascii_dist", "alt_name_log")


@_query("WITH " + _cand() + ", " + _DIST + "SELECT doc_id, mention_id, slot, " + ", ".join(f"round({c}, 6) AS {c}" for c in _DISTS) + " FROM feat")
def edit_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.name_features(_candidates(spark, sf_dir)[1])
    return _rounded(rows.select("doc_id", "mention_id", "slot", *_DISTS), *_DISTS)


@_query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER w) / if(max(l_extendedprice) OVER w = 0, 0.001, max(l_extendedprice) OVER w), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fm.min_max(F.col("l_extendedprice"), Window.partitionBy("l_orderkey")), 6).alias("scaled"))


_PARENT = "('', ''), ('DEU', ''), ('DEU', 'Province 3'), ('USA', 'Province 3')"


@_query(_with(demo.GAZETTEER, f"p(parent_country, parent_adm1) AS (VALUES {_PARENT})") + """SELECT geonameid, parent_country, parent_adm1, if(parent_country = '' OR parent_adm1 = '', 0, if(admin1_name = parent_adm1 AND country_code3 = parent_country, 1, -1)) AS adm1_parent_match,
if(parent_country = '' OR parent_adm1 = '', 0, if(admin1_name = parent_adm1, 1, -1)) AS adm1_strict, if(parent_country = '', 0, if(country_code3 = parent_country, 1, -1)) AS country_parent_match FROM gaz, p""")
def parent_match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.explode(F.array(*(F.struct(F.lit(a).alias("c"), F.lit(b).alias("d")) for a, b in (("", ""), ("DEU", ""), ("DEU", "Province 3"), ("USA", "Province 3")))))
    rows = demo.gazetteer(spark, sf_dir).withColumn("p", p).withColumns({"parent_country": F.col("p.c"), "parent_adm1": F.col("p.d")})
    strict = ft.parent_features(rows, True).withColumnRenamed("adm1_parent_match", "adm1_strict").drop("country_parent_match")
    return ft.parent_features(strict).select("geonameid", "parent_country", "parent_adm1", "adm1_parent_match", "adm1_strict", "country_parent_match")


_COHERENCE = """nm AS (SELECT doc_id, count(DISTINCT mention_id) AS nm FROM cand GROUP BY 1),
ca AS (SELECT doc_id, country_code3, admin1_name, count(DISTINCT mention_id) AS a FROM cand WHERE admin1_name <> '' GROUP BY ALL), cc AS (SELECT doc_id, country_code3, count(DISTINCT mention_id) AS c FROM cand GROUP BY ALL),
coh AS (SELECT f.*, coalesce(a, 0) / nm AS adm1_count, coalesce(c, 0) / nm AS country_count FROM {f} f JOIN nm USING (doc_id) LEFT JOIN ca USING (doc_id, country_code3, admin1_name) LEFT JOIN cc USING (doc_id, country_code3))"""


@_query("WITH " + _cand() + ", " + _COHERENCE.format(f="cand") + "SELECT doc_id, mention_id, slot, round(adm1_count, 6) AS adm1_count, round(country_count, 6) AS country_count FROM coh")
def document_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.coherence(_candidates(spark, sf_dir)[1])
    return _rounded(rows.select("doc_id", "mention_id", "slot", "adm1_count", "country_count"), "adm1_count", "country_count")


@_query("WITH " + _cand() + """SELECT doc_id, mention_id, slot, geonameid, feature_code, country_code3 FROM cand UNION ALL
SELECT m.doc_id, m.mention_id, (SELECT count(*) FROM cand c WHERE c.doc_id = m.doc_id AND c.mention_id = m.mention_id)::INT, 'NULL', 'NULL', 'NULL' FROM men m""")
def null_slot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows, _ = _candidates(spark, sf_dir)
    return ft.with_null_candidate(rows, m).select("doc_id", "mention_id", "slot", "geonameid", "feature_code", "country_code3")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored slots, each with its candidate's id."""
    m, rows, _ = _candidates(spark, sf_dir)
    rows = ft.coherence(ft.with_null_candidate(ft.parent_features(ft.name_features(rows).withColumns({"parent_country": F.lit(""), "parent_adm1": F.lit("")})), m))
    return sc.linear_scores(ft.packed(rows.withColumns({"code_idx": F.lit(1), "country_idx": F.lit(1)}), SLOTS, 0, ("geonameid",)))


_W = dict(zip(ft.FEATURES, sc.WEIGHTS))
_LOGIT = "CASE WHEN slot = {last} THEN {minus} WHEN real = 1 THEN {real} WHEN real = 2 THEN {null} ELSE {pad} END".format(
    last=SLOTS - 1, minus=-sum(sc.WEIGHTS), real=" + ".join(f"{w} * {c}" for c, w in _W.items() if not c.endswith("_match")),
    null=sum(w * (ft.PADDING if c.endswith("_dist") else -1 if c.endswith("_match") else 0) for c, w in _W.items()), pad=sum(w * (0 if c.endswith(("_count", "_match")) else ft.PADDING) for c, w in _W.items()),
)
_SCORED = (
    _cand() + ", " + _DIST + ", " + _COHERENCE.format(f="feat")
    + f""", grid AS (SELECT doc_id, mention_id, unnest(range(0, {SLOTS}))::INT AS slot FROM men), nc AS (SELECT doc_id, mention_id, count(c.geonameid)::INT AS nc FROM men LEFT JOIN cand c USING (doc_id, mention_id) GROUP BY ALL),
lo AS (SELECT g.doc_id, g.mention_id, g.slot, if(g.slot < nc, 1, if(g.slot = nc, 2, 0)) AS real, alt_name_log, max_dist, avg_dist, min_dist, ascii_dist, adm1_count, country_count, geonameid FROM grid g JOIN nc USING (doc_id, mention_id) LEFT JOIN coh USING (doc_id, mention_id, slot)),
ex AS (SELECT *, {_LOGIT} AS logit FROM lo), sco AS (SELECT *, exp(logit - max(logit) OVER w) / 1.0 AS e FROM ex WINDOW w AS (PARTITION BY doc_id, mention_id)), scored AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, mention_id) AS score FROM sco)"""
)


@_query("WITH " + _SCORED + " SELECT doc_id, mention_id, slot, real > 0 AS real, round(score, 6) AS score FROM scored")
def linear_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir).select("doc_id", "mention_id", "slot", "real", "score"), "score")


_ORDER = "ORDER BY round(score, 9) DESC, slot"
_RANKED = f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_id {_ORDER}) AS r, max(round(score, 9)) OVER (PARTITION BY doc_id, mention_id) AS best, max(if(slot = {SLOTS - 1}, round(score, 9), NULL)) OVER (PARTITION BY doc_id, mention_id) AS last FROM scored),
reals AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_id {_ORDER}) AS rr FROM ranked WHERE real > 0), heads AS (SELECT doc_id, mention_id, CASE WHEN last = best THEN 'no answer' WHEN real = 2 THEN 'no entry' ELSE '' END AS reason FROM reals WHERE rr = 1)"""


def _top(spark: SparkSession, sf_dir: str, n: int, strict: bool = False) -> DataFrame:
    m, rows, _ = _candidates(spark, sf_dir)
    rows = ft.name_features(rows).withColumns({"parent_country": F.lit(""), "parent_adm1": F.lit("")})
    rows = ft.coherence(ft.parent_features(ft.with_mentions(rows, m)))
    best = rs.resolve_arrays(sl.scored(rows, SLOTS, sc.WEIGHTS, ("geonameid",), places=9), n, strict)
    return best.select("doc_id", "mention_id", "rank", "place.geonameid", "reason")


def _top_sql(n: int, strict: bool = False) -> str:
    return "WITH " + _SCORED + _RANKED + f"""SELECT r.doc_id, r.mention_id, rr::INT AS rank, geonameid, '' AS reason FROM reals r JOIN heads h USING (doc_id, mention_id) WHERE reason = '' AND rr <= {n} AND real = 1
UNION ALL SELECT r.doc_id, r.mention_id, rr::INT, 'NULL', '' FROM reals r JOIN heads h USING (doc_id, mention_id) WHERE reason = '' AND rr <= {n} AND real = 2
UNION ALL SELECT doc_id, mention_id, 1, NULL, reason FROM heads WHERE reason {"= 'no answer'" if strict else "<> ''"}"""


@_query(_top_sql(1))
def resolve_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 1)


@_query(_top_sql(4))
def resolve_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 4)


_SLOT_SCORES = "(1, 0, 0, 0.5, true), (1, 0, 1, 0.2, true), (1, 0, 7, 0.3, false), (2, 0, 0, 0.2, true), (2, 0, 1, 0.1, true), (2, 0, 7, 0.7, false), (3, 0, 0, 0.2, true), (3, 0, 1, 0.5, true), (3, 0, 7, 0.3, false), (4, 0, 0, 0.4, true), (4, 0, 1, 0.4, true), (4, 0, 2, 0.1, true), (4, 0, 7, 0.1, false), (5, 0, 3, 0.9, false), (5, 0, 7, 0.1, false), (6, 0, 0, 0.3, true), (6, 0, 7, 0.7, true)"


@_query(f"""WITH t(doc_id, mention_id, slot, score, real) AS (VALUES {_SLOT_SCORES}), m AS (SELECT doc_id, max(score) AS best, max(if(slot = 7, score, NULL)) AS last, max(if(real, slot, NULL)) AS none, arg_max(slot, if(real, score * 1000 - slot, NULL)) AS top FROM t GROUP BY 1),
r AS (SELECT *, CASE WHEN last = best THEN 'no answer' WHEN none IS NULL THEN 'no candidates' WHEN top = none THEN 'no entry' ELSE '' END AS reason FROM m) SELECT doc_id, if(reason = '', top, NULL) AS slot, 1 AS rank, reason, reason IN ('', 'no answer') AS in_strict FROM r""")
def no_answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.literal(spark, _SLOT_SCORES, "doc_id, mention_id, slot, score, real").withColumn("score", F.col("score").cast("double"))
    strict = rs.resolve(rows, 8, 1, True).select("doc_id", F.lit(True).alias("in_strict"))
    return rs.resolve(rows, 8).join(strict, "doc_id", "left").select("doc_id", "slot", "rank", "reason", F.coalesce("in_strict", F.lit(False)).alias("in_strict"))


@_query("WITH " + _SCORED + f", b AS (SELECT doc_id, mention_id, slot, row_number() OVER (PARTITION BY doc_id, mention_id {_ORDER}) AS r FROM scored WHERE real > 0 AND round(score, 9) > 0.01) SELECT doc_id, mention_id, slot, r::INT AS rank FROM b WHERE r <= 3")
def best_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.best_over(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)), 0.01, 3).select("doc_id", "mention_id", "slot", "rank")


@_query(_with(demo.GAZETTEER) + """, o AS (SELECT geonameid, row_number() OVER (ORDER BY geonameid) AS r FROM gaz), n AS (SELECT count(*) AS n FROM gaz), hier AS (SELECT a.geonameid AS child_id, b.geonameid AS parent_id FROM o a, n JOIN o b ON b.r = a.r + 1 WHERE a.r % 4 <> 0)
SELECT g.geonameid, CASE WHEN g.feature_code = 'PPLX' AND h.parent_id IS NULL THEN g.geonameid WHEN (g.feature_code = 'PPLX' OR g.feature_class = 'S') THEN if(p.feature_class = 'P', p.geonameid, '') WHEN contains(g.feature_code, 'PPL') THEN g.geonameid ELSE '' END AS city_id,
CASE WHEN g.feature_code = 'PPLX' AND h.parent_id IS NULL THEN g.name WHEN (g.feature_code = 'PPLX' OR g.feature_class = 'S') THEN if(p.feature_class = 'P', p.name, '') WHEN contains(g.feature_code, 'PPL') THEN g.name ELSE '' END AS city_name
FROM gaz g LEFT JOIN hier h ON h.child_id = g.geonameid LEFT JOIN gaz p ON p.geonameid = h.parent_id""")
def city_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.gazetteer(spark, sf_dir)
    o = g.select("geonameid").withColumn("r", F.row_number().over(Window.orderBy("geonameid")))  # the fixture's hierarchy, of a few hundred entries
    up = o.where("r % 4 <> 0").select(F.col("geonameid").alias("child_id"), (F.col("r") + 1).alias("r")).join(o.select(F.col("geonameid").alias("parent_id"), "r"), "r").select("child_id", "parent_id")
    return rs.with_city(g, g, up).select("geonameid", "city_id", "city_name")


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + "SELECT d.doc_id, length(text)::INT AS text_length, count(m.mention_id) AS n_places, coalesce(string_agg(m.search_name || '@' || m.start_char, ' ' ORDER BY m.mention_id), '') AS places FROM documents d LEFT JOIN men m USING (doc_id) GROUP BY ALL")
def document_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.documents_out(demo.read(spark, sf_dir, "documents"), demo.mentions(spark, sf_dir).drop("in_rel"))
    return out.select("doc_id", F.length("doc_text").alias("text_length"), F.size("geolocated_ents").cast("long").alias("n_places"), F.array_join(F.transform("geolocated_ents", lambda x: F.concat(x.search_name, F.lit("@"), x.start_char.cast("string"))), " ").alias("places"))


@_query()
def neural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neural scorer with seeded weights, on vectors from a hash of document and mention."""
    m, slots, dims = demo.mentions(spark, sf_dir), _scored(spark, sf_dir).drop("place"), 16
    vec = lambda salt: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.pmod(F.xxhash64("doc_id", "mention_id", F.lit(salt), i), F.lit(1000)) / 500 - 1).cast("double"))
    vectors = m.select("doc_id", "mention_id", vec(1).alias("tensor"), vec(2).alias("doc_tensor"), vec(3).alias("locs_tensor"))
    return sc.neural_scores(slots.drop("score"), vectors, sc.random_weights(3, bert=dims))


@_query("WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS similarity FROM u JOIN m USING (label, i) GROUP BY vec_id, label")
def vector_mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine with the mean of its label's."""
    e = demo.read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))
    return e.join(means, "label").select("vec_id", "label", F.round(fm.cosine(F.col("embedding"), F.col("mean")), 5).alias("similarity"))


# ---- events, evaluation, training


@_query(f"""WITH t({demo.EVENT_COLUMNS}) AS (VALUES {demo.EVENT_GEO}), e AS (SELECT event_id, count(*) AS n, count(DISTINCT name) AS names, sum((start_char BETWEEN qs AND qe)::INT) AS k, arg_min(name, k) AS first_name, arg_min(name, if(start_char BETWEEN qs AND qe, k, NULL)) AS in_name, arg_min(name, if(start_char BETWEEN qs AND qe AND feature_class = 'P', k, NULL)) AS place FROM t GROUP BY 1)
SELECT event_id, CASE WHEN k = 0 AND names = 1 THEN first_name WHEN k = 1 THEN in_name WHEN k > 1 THEN place END AS event_loc, CASE WHEN k = 0 AND n = 1 THEN '{ev.REASONS["one"]}' WHEN k = 0 AND names = 1 THEN '{ev.REASONS["one_unique"]}' WHEN k = 0 THEN '{ev.REASONS["many"]}' WHEN k = 1 THEN '{ev.REASONS["match"]}' WHEN place IS NOT NULL THEN '{ev.REASONS["place"]}' ELSE '{ev.REASONS["no_place"]}' END AS event_loc_reason FROM e
UNION ALL SELECT 99, NULL, '{ev.REASONS["none"]}'""")
def event_pick_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.literal(spark, demo.EVENT_GEO, demo.EVENT_COLUMNS)
    events = rows.groupBy("event_id").agg(F.first(F.struct(F.col("qs").alias("start"), F.col("qe").alias("end"))).alias("qa"), F.array_sort(F.collect_list(F.struct("k", "name", "feature_class", "feature_code", "start_char"))).alias("geo"))
    events = events.unionByName(events.where("event_id = 1").select(F.lit(99).alias("event_id"), "qa", F.slice("geo", 1, 0).alias("geo")))
    return ev.pick_event_location(events).select("event_id", F.col("event_loc.name").alias("event_loc"), "event_loc_reason")


@_query("SELECT conv_id AS storyid, turn AS event_id, 'Where did ' || lower(role) || ' happen?' AS question, 'Which place did ' || lower(role) || ' happen?' AS question_ui, role || '. ' || text AS body FROM conversations")
def event_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("storyid"), F.col("turn").alias("event_id"), ev.question(F.col("role")).alias("question"), ev.question(F.col("role"), "Which place did").alias("question_ui"), ev.headline_text(F.col("role"), F.col("text")).alias("body"))


def _events_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a gold one and scores by md5, in four datasets."""
    g = demo.gazetteer(spark, sf_dir).withColumn("h", F.md5("geonameid")).withColumn("g", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % 40)
    w = Window.partitionBy("g").orderBy("geonameid")
    rows = g.select(F.concat(F.lit("set"), (F.col("g") % 4).cast("string")).alias("dataset"), F.col("g").cast("long").alias("doc_id"), F.lit(0).alias("mention_id"), (F.row_number().over(w) - 1).alias("slot"), (F.conv(F.substring("h", 3, 4), 16, 10).cast("long") / 65536).alias("score"), "geonameid", "country_code3", "feature_code", "admin1_code", "lat", "lon", "h", "g")
    gold = F.max_by(F.col("slot"), F.substring("h", 8, 6)).over(Window.partitionBy("g"))
    return rows.withColumn("is_correct", (F.col("g") % 5 != 0) & (F.col("slot") == gold)).drop("h", "g")


_EVAL = demo.GAZETTEER + """, e0 AS (SELECT *, md5(geonameid) AS hh, ('0x' || substr(md5(geonameid), 1, 2))::INT % 40 AS g FROM gaz), e1 AS (SELECT 'set' || g % 4 AS dataset, g::BIGINT AS doc_id, 0 AS mention_id, (row_number() OVER (PARTITION BY g ORDER BY geonameid) - 1)::INT AS slot, ('0x' || substr(hh, 3, 4))::BIGINT / 65536 AS score, geonameid, country_code3, feature_code, admin1_code, lat, lon, hh, g FROM e0),
e2 AS (SELECT *, g % 5 <> 0 AND slot = arg_max(slot, substr(hh, 8, 6)) OVER (PARTITION BY g) AS is_correct, count(*) OVER (PARTITION BY g) AS n FROM e1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slot) AS r FROM e2), pg AS (SELECT a.dataset, a.doc_id, a.n, a.slot AS ps, b.slot AS gs, a.country_code3 = b.country_code3 AS okc, a.feature_code = b.feature_code AS okf, a.admin1_code = b.admin1_code AS oka, a.geonameid = b.geonameid AS oki,
2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) AS km0 FROM p a LEFT JOIN (SELECT * FROM p WHERE is_correct) b USING (doc_id) WHERE a.r = 1),
mk AS (SELECT *, gs IS NULL OR (gs = n - 1 AND ps = n - 1) AS missing, (gs IS NULL OR (gs = n - 1 AND ps = n - 1)) AND ps = n - 1 AS credited FROM pg), ev AS (SELECT *, if(missing, NULL, okc::INT) AS oc, if(missing, NULL, okf::INT) AS ofc, if(missing, NULL, oka::INT) AS oa, if(missing, NULL, oki::INT) AS oi, if(missing, NULL, km0) AS km FROM mk)"""
_AVGS = "round(avg(oc), 6) AS correct_country, round(avg(ofc), 6) AS correct_code, round(avg(oa), 6) AS correct_adm1, round(avg(oi), 6) AS exact_match, round(avg(km), 3) AS avg_dist, round(median(km), 3) AS median_dist, round(avg((km <= 161)::INT), 6) AS acc_at_161"


@_query("WITH " + _EVAL + f"SELECT dataset, count(*) AS mentions, {_AVGS}, round(coalesce(sum(credited::INT) / nullif(sum(missing::INT), 0), 0), 6) AS missing_correct, round(avg(missing::INT), 6) AS total_missing FROM ev GROUP BY dataset")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evl.evaluate(_events_fixture(spark, sf_dir), "dataset")
    return _rounded(_rounded(out, "avg_dist", "median_dist", places=3), "correct_country", "correct_code", "correct_adm1", "exact_match", "acc_at_161", "missing_correct", "total_missing")


@_query("WITH " + _EVAL + "SELECT dataset, round(avg(oi), 6) AS exact_match, round(avg(oc), 6) AS correct_country, count(*) AS mentions FROM ev GROUP BY ROLLUP (dataset)")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evl.report(_events_fixture(spark, sf_dir)), "exact_match", "correct_country")


@_query("WITH " + _EVAL + ", d AS (SELECT dataset, avg(oi) AS a, avg(oc) AS b, avg(ofc) AS c, avg(oa) AS d, avg(km) AS e, avg((km <= 161)::INT) AS f FROM ev GROUP BY 1) SELECT round(avg(a), 6) AS exact_match, round(avg(b), 6) AS correct_country, round(avg(c), 6) AS correct_code, round(avg(d), 6) AS correct_adm1, round(avg(e), 3) AS avg_dist, round(avg(f), 6) AS acc_at_161 FROM d")
def eval_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evl.macro_average(evl.evaluate(_events_fixture(spark, sf_dir), "dataset"))
    return _rounded(_rounded(out, "avg_dist", places=3), *(m for m in evl.METRICS if m != "avg_dist"))


@_query("WITH " + _EVAL + ", h AS (SELECT dataset, doc_id, max((is_correct AND slot < 2)::INT) AS hit FROM e2 GROUP BY ALL) SELECT dataset, round(1 - avg(hit), 6) AS missing_share FROM h GROUP BY 1")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evl.missing_at(_events_fixture(spark, sf_dir), 2, "dataset"), "missing_share")


@_query("SELECT s_suppkey, c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(c_acctbal / 200 - s_acctbal / 200) / 2), 2) + cos(radians(s_acctbal / 200)) * cos(radians(c_acctbal / 200)) * pow(sin(radians(c_nationkey - s_nationkey) / 2), 2)))), 3) AS km FROM supplier JOIN customer ON s_suppkey = c_custkey")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = demo.read(spark, sf_dir, "supplier"), demo.read(spark, sf_dir, "customer")
    km = fm.haversine_km(F.col("s_acctbal") / 200, F.col("s_nationkey").cast("double"), F.col("c_acctbal") / 200, F.col("c_nationkey").cast("double"))
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", F.round(km, 3).alias("km"))


@_query("SELECT round(100 * avg((quality = toxic)::INT)) AS percent FROM labels")
def percent_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evl.percent_correct(demo.read(spark, sf_dir, "labels"), "quality", "toxic")


@_query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.7) AS is_train FROM customer")
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.split_mark(demo.read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), 0.7, "c_custkey", "c_mktsegment")


_OPTIONS = "(1, 'accept', 'a', 'Berlin 2950159', 3, 9), (2, 'reject', 'a', 'x 1', 0, 1), (3, 'accept', '', 'y 2', 0, 1), (4, 'accept', 'a', 'None of these', 0, 1), (5, 'accept', 'a', 'Homs, SYR 169577', 5, 9)"


@_query(rf"""WITH t(id, answer, acc, option, s, e) AS (VALUES {_OPTIONS}) SELECT 'text ' || id AS text, s AS "start", e AS "end", regexp_extract(option, '(\d+)$', 1) AS gold_id FROM t WHERE answer = 'accept' AND acc <> '' AND regexp_extract(option, '(\d+)$', 1) <> ''""")
def training_from_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = demo.literal(spark, _OPTIONS, "id, answer, acc, option, s, e")
    rows = t.select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), "answer", F.when(F.col("acc") == "", F.array().cast("array<string>")).otherwise(F.array("acc")).alias("accept"), F.array(F.struct(F.lit("a").alias("id"), F.col("option").alias("text"))).alias("options"), F.array(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("spans"))
    return tr.from_options(rows)


@_query("WITH " + _EVAL + "SELECT doc_id, mention_id, coalesce(min(if(is_correct, slot, NULL)), 2)::INT AS label, coalesce(arg_min(country_code3, if(is_correct, slot, NULL)), 'NULL') AS country FROM e2 WHERE slot < 3 GROUP BY ALL")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.labels(_events_fixture(spark, sf_dir), 3)


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + ", g AS (SELECT doc_id, start_char - 1 AS s, end_char + 40 AS e, start_char::VARCHAR AS gold_id FROM men WHERE mention_id % 3 = 0), h AS (SELECT m.doc_id, mention_id, gold_id, row_number() OVER (PARTITION BY m.doc_id, s, e ORDER BY start_char, mention_id) AS r FROM men m JOIN g ON m.doc_id = g.doc_id AND start_char >= s AND start_char < e), f AS (SELECT doc_id, mention_id, min(gold_id) AS gold_id FROM h WHERE r = 1 GROUP BY ALL) SELECT m.doc_id, m.mention_id, gold_id FROM men m LEFT JOIN f USING (doc_id, mention_id)")
def training_attach_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = demo.mentions(spark, sf_dir)
    gold = m.where("mention_id % 3 = 0").select("doc_id", (F.col("start_char") - 1).alias("start"), (F.col("end_char") + 40).alias("end"), F.col("start_char").cast("string").alias("gold_id"))
    return tr.attach_gold(m, gold).select("doc_id", "mention_id", "gold_id")


_SENTENCES = "(1, 'a', 1, 4, CAST(NULL AS INT), CAST(NULL AS INT)), (2, 'b', CAST(NULL AS INT), CAST(NULL AS INT), 10, 14), (3, 'c', 2, 3, 20, 21)"
_SENTENCE_COLUMNS = "correct_geonamesid, text, start_char_sent, end_char_sent, start_char_doc, end_char_doc"


@_query(f"WITH t({_SENTENCE_COLUMNS}) AS (VALUES {_SENTENCES}) SELECT text, coalesce(start_char_sent, start_char_doc) AS \"start\", coalesce(end_char_sent, end_char_doc) AS \"end\", correct_geonamesid::VARCHAR AS gold_id FROM t")
def training_from_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.from_sentences(demo.literal(spark, _SENTENCES, _SENTENCE_COLUMNS))


_TOPONYMS = "('In Homs.', 3, 7, 'Homs', '169577'), ('In Homs.', 0, 2, 'In', ''), ('To Aleppo', 3, 9, 'Aleppo', '170063')"


@_query(f"WITH t(text, s, e, name, gold_id) AS (VALUES {_TOPONYMS}) SELECT text, s AS \"start\", e AS \"end\", name, gold_id FROM t WHERE gold_id <> ''")
def training_from_toponyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = demo.literal(spark, _TOPONYMS, "text, s, e, name, gold_id")
    one = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("name").alias("extractedName"), F.col("gold_id").alias("geonamesID"))
    return tr.from_toponyms(t.groupBy("text").agg(F.struct(F.collect_list(one).alias("toponym")).alias("toponyms")), "gwn")


@_query("WITH " + _cand() + ", q AS (SELECT *, slot % 3 = 1 AS is_correct FROM cand) SELECT doc_id, mention_id, slot, is_correct, NOT is_correct AS is_negative FROM q")
def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of candidates, and those that stay when the right ones are taken out."""
    rows = _candidates(spark, sf_dir)[1].withColumn("gold_id", F.when(F.col("slot") % 3 == 1, F.col("geonameid")))
    marked = ft.correct(rows).select("doc_id", "mention_id", "slot", "is_correct")
    rest = ft.without_gold(rows).select("doc_id", "mention_id", "slot", F.lit(True).alias("is_negative"))
    return marked.join(rest, ["doc_id", "mention_id", "slot"], "left").withColumn("is_negative", F.coalesce("is_negative", F.lit(False)))


@_query("WITH " + _cand() + ", nc AS (SELECT doc_id, mention_id, count(c.geonameid)::INT AS nc FROM men LEFT JOIN cand c USING (doc_id, mention_id) GROUP BY ALL), grid AS (SELECT doc_id, mention_id, nc, unnest(range(0, 5))::INT AS slot FROM nc)"
        " SELECT doc_id, mention_id, slot, (CASE WHEN slot = 4 THEN 53 WHEN slot < nc THEN 1 ELSE 52 END)::INT AS code_idx, (slot <= nc) AS real, (CASE WHEN slot = 4 THEN -1 WHEN slot < nc THEN 0.5 WHEN slot = nc THEN 99 ELSE 99 END)::DOUBLE AS max_dist, (CASE WHEN slot = 4 THEN -1 WHEN slot < nc THEN 1 WHEN slot = nc THEN -1 ELSE 0 END)::DOUBLE AS country_parent_match FROM grid")  # fmt: skip
def slot_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five slots of each mention: candidates, the one for no entry, padding, the last one overwritten."""
    m, rows, _ = _candidates(spark, sf_dir)
    rows = rows.withColumns({**{c: F.lit(0.5) for c in ft.FEATURES if not c.endswith("_match")}, **{c: F.lit(1) for c in ft.FEATURES if c.endswith("_match")}, "code_idx": F.lit(1), "country_idx": F.lit(1)})
    rows = ft.with_null_candidate(rows, m).withColumns({"code_idx": F.coalesce("code_idx", F.lit(ft.NULL_CODE)), "country_idx": F.coalesce("country_idx", F.lit(0))})
    at = lambda c: F.get("features", F.lit(ft.FEATURES.index(c))).alias(c)
    return ft.packed(rows, 5, 0).select("doc_id", "mention_id", "slot", "code_idx", "real", at("max_dist"), at("country_parent_match"))


@_query("WITH t AS (SELECT (vec_id // 10)::BIGINT AS doc_id, (vec_id % 10)::INT AS token, label, embedding FROM embeddings), u AS (SELECT doc_id, token, label % 2 = 0 AS context, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM t), m(mention_id, f, l) AS (VALUES (0, 0, 2), (1, 4, 5)),"
        " v AS (SELECT doc_id, mention_id, i, avg(if(token >= f AND token < l, x, NULL)) AS a, avg(x) AS b, avg(if(context AND NOT (token >= f AND token < l), x, NULL)) AS c FROM u, m GROUP BY ALL)"
        " SELECT doc_id, mention_id, round(sum(coalesce(a, 0)), 5) AS tensor, round(sum(b), 5) AS doc_tensor, round(sum(coalesce(c, 0)), 5) AS locs_tensor FROM v GROUP BY ALL")  # fmt: skip
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the vectors of mentions, documents and other places, with ten vectors of the table as a document."""
    e = demo.read(spark, sf_dir, "embeddings")
    n = len(e.select("embedding").first()[0])
    tokens = e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("token"), F.when(F.col("label") % 2 == 0, "NORP").otherwise("").alias("label"), F.col("embedding").alias("vec"))
    found = tokens.select("doc_id").distinct().withColumn("m", F.explode(F.array(*(F.struct(F.lit(k).alias("mention_id"), F.lit(i).alias("first"), F.lit(j).alias("last")) for k, i, j in ((0, 0, 2), (1, 4, 5)))))).select("doc_id", "m.*")
    out = mn.context_vectors(tokens, found, n)
    return out.select("doc_id", "mention_id", *(F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), 5).alias(c) for c in ("tensor", "doc_tensor", "locs_tensor")))


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + "SELECT doc_id, coalesce(string_agg(if(mention_id % 2 = 0, search_name, NULL), ' ' ORDER BY start_char), '') AS event_location_raw FROM men GROUP BY doc_id")
def event_location_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = demo.mentions(spark, sf_dir).withColumn("label", F.when(F.col("mention_id") % 2 == 0, "EVENT_LOC").otherwise("GPE"))
    return mn.event_location_text(m)


@_query(_with(demo.GAZETTEER, demo.MENTIONS) + "SELECT d.doc_id, count(m.mention_id) AS n_before FROM documents d JOIN men m ON m.doc_id = d.doc_id GROUP BY d.doc_id HAVING true".replace("count(m.mention_id)", "count(if(m.start_char < length(d.text) // 2, 1, NULL))"))
def event_mention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that start before the end of a document's first half."""
    docs = demo.read(spark, sf_dir, "documents")
    geo = demo.mentions(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("search_name").alias("geonameid"), "start_char")).alias("geo"))
    half = docs.select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("partial_doc")).join(geo, "doc_id")
    return ev.mentions_before(half).select("doc_id", F.size("geo").cast("long").alias("n_before"))


_EVENT_ROWS = "(1, 'Berlin', 'DEU', 'Match'), (2, 'Homs', 'SYR', 'Match'), (3, CAST(NULL AS STRING), CAST(NULL AS STRING), 'No')"


@_query(f"WITH t(event_id, p, c, event_loc_reason) AS (VALUES {_EVENT_ROWS}), i(code3, name) AS (VALUES ('DEU', 'Germany')) SELECT event_id, p AS place, p AS province, coalesce(name, c) AS country, event_loc_reason FROM t LEFT JOIN i ON c = code3")
def event_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.literal(spark, _EVENT_ROWS, "event_id, p, c, event_loc_reason")
    loc = F.struct(F.col("p").alias("name"), F.lit("").alias("admin2_name"), F.col("p").alias("admin1_name"), F.col("c").alias("country_code3"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("1").alias("geonameid"))
    events = rows.withColumns({"event_loc": loc, "qa": F.struct(F.lit("x").alias("answer"))})
    return ev.event_rows(events, demo.literal(spark, "('DEU', 'Germany')", "code3, name")).select("event_id", "place", "province", "country", "event_loc_reason")


_STORIES = "(1, '[{\"event_id\": 10, \"name\": \"A\"}, {\"event_id\": 11, \"name\": \"B\"}]'), (2, '[]'), (3, '[{\"event_id\": 12, \"name\": \"C\"}]')"


@_query(f"WITH t(storyid, events) AS (VALUES {_STORIES}), e AS (SELECT storyid, unnest(json_extract(events, '$[*]')) AS x FROM t) SELECT storyid::BIGINT AS storyid, json_extract(x, '$.event_id')::BIGINT AS event_id, json_extract_string(x, '$.name') AS name, 'H' || storyid AS \"Headline\" FROM e")
def story_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = demo.literal(spark, _STORIES, "storyid, events")
    kind = "array<struct<event_id: long, text: string, name: string, sentence_num: int>>"
    stories = t.select(F.col("storyid").cast("long").alias("storyid"), F.concat(F.lit("H"), F.col("storyid").cast("string")).alias("Headline"), F.lit("").alias("Rawtext"), F.from_json("events", kind).alias("events"))
    return readers.story_events(stories).select("storyid", "event_id", "name", "Headline")


@_query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.read(spark, sf_dir, "nation").select("n_nationkey", sinks.as_json("n_nationkey", "n_name").alias("json"))


@_query("WITH " + large.SQL)
def large_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of hot and rare words in a gazetteer of a hundred entries a document."""
    return large.search(spark, sf_dir)


@_query()
def large_geoparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on that gazetteer."""
    return large.geoparse(spark, sf_dir)


@_query()
def geoparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: documents to resolved places."""
    g = demo.gazetteer(spark, sf_dir)
    names = [r.asciiname for r in g.select("asciiname").distinct().collect()]  # a parameter of the tagger: some hundred words of the benchmark
    parser = Geoparser(g, gz.ranked_index(g), mn.DictionaryTagger(names))
    return parser.resolved(demo.read(spark, sf_dir, "documents"))

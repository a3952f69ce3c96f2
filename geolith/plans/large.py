"""A synthetic gazetteer that grows with the documents, and searches on it.

A hundred entries a document, so a million at scale factor 0.1, with names from a hash of their number: words that
thousands of entries share (San, North), words of the benchmark, which the documents mention, and made-up ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import gazetteer as gz
from geolith.operators import retrieval as rt
from geolith.operators.mentions import DictionaryTagger
from geolith.plans import demo
from geolith.plans.geoparse import Geoparser

ENTRIES = 100
HOT = ["San", "North", "New", "Lake", "Old", "Upper"]
SYLLABLES = "ba ko li mur den tas ve rho pin sal gor ek mi zan lu fen".split()
KINDS = (("P", "PPL"), ("A", "ADM1"), ("P", "PPLX"), ("S", "SQR"), ("A", "PCLI"), ("P", "PPLA"))
COUNTRIES = ["USA", "DEU", "NLD", "FRA", "SYR", "BRA", "IND"]


def _part(k: int, values: list) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int") % len(values) + 1).cast("int"))


def words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The demo gazetteer's plain names, sorted: some hundred words of the benchmark."""
    return sorted(r.asciiname for r in demo.gazetteer(spark, sf_dir).select("asciiname").distinct().collect())


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = demo.read(spark, sf_dir, "documents").count() * ENTRIES
    known = words(spark, sf_dir)
    number = lambda k: F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int")
    made = F.initcap(F.concat(*(_part(k, SYLLABLES) for k in (0, 1, 2)), F.when(number(3) % 2 == 0, _part(4, SYLLABLES)).otherwise("")))
    word = F.when(number(5) % 50 == 0, _part(6, known)).otherwise(made)
    name = F.when(number(7) % 8 == 0, F.concat(_part(3, HOT), F.lit(" "), word)).otherwise(word)
    rows = spark.range(n).select(F.col("id").cast("string").alias("geonameid"), F.md5(F.col("id").cast("string")).alias("h")).withColumn("name", name)
    alts = F.array_distinct(F.array(F.concat("name", F.lit("burg")), F.concat(F.lit("Port "), F.col("name"))))
    kind = number(2) % len(KINDS)
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in KINDS)), kind + 1)
    return rows.select(
        "geonameid", "name", F.col("name").alias("asciiname"), alts.alias("alternativenames"), (number(0) / 364.1 - 90).alias("lat"), (number(1) / 182.05 - 180).alias("lon"),
        pick(0).alias("feature_class"), pick(1).alias("feature_code"), _part(4, COUNTRIES).alias("country_code3"), (number(3) % 9).cast("string").alias("admin1_code"), F.concat(F.lit("Province "), (number(3) % 9).cast("string")).alias("admin1_name"),
        F.lit("").alias("admin2_code"), F.lit("").alias("admin2_name"), F.lit("").alias("admin3_code"), F.lit("").alias("admin4_code"), (number(6) * 10).cast("long").alias("population"), (number(5) % 40).alias("alt_name_length"), F.to_date(F.lit("2024-01-01")).alias("modification_date"),
    )


def search(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """The first k entries of each hot word, each known word, and each with North before, through a ranked index."""
    g = gazetteer(spark, sf_dir)
    known = words(spark, sf_dir)
    names = spark.createDataFrame([(x,) for x in [*HOT, *known, *(f"North {x}" for x in known)]], "query string")
    return rt.phrase_search(names, gz.ranked_index(g), g, k)


def parser(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> Geoparser:
    g = gazetteer(spark, sf_dir)
    return Geoparser(g, index, DictionaryTagger(words(spark, sf_dir)))


def geoparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on the large gazetteer: documents to resolved places."""
    return parser(spark, sf_dir).resolved(demo.read(spark, sf_dir, "documents"))


_N = "('0x' || substr(h, {}, 4))::INT"


def _sql_part(k: int, values: list[str] | str, n: str) -> str:
    listed = values if isinstance(values, str) else "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{listed}[{_N.format(4 * k + 1)} % {n} + 1]"


_WORD = "known[{} % len(known) + 1]".format(_N.format(25))
SQL = demo.GAZETTEER + f""", kw AS (SELECT list(w ORDER BY w) AS known FROM (SELECT DISTINCT asciiname AS w FROM gaz)),
lh AS (SELECT i::VARCHAR AS geonameid, md5(i::VARCHAR) AS h FROM range((SELECT count(*) * {ENTRIES} FROM documents)) t(i)),
lw AS (SELECT geonameid, h, CASE WHEN {_N.format(21)} % 50 = 0 THEN {_WORD} ELSE upper(substr(m, 1, 1)) || substr(m, 2) END AS word
  FROM (SELECT *, {" || ".join(_sql_part(k, SYLLABLES, str(len(SYLLABLES))) for k in (0, 1, 2))} || CASE WHEN {_N.format(13)} % 2 = 0 THEN {_sql_part(4, SYLLABLES, str(len(SYLLABLES)))} ELSE '' END AS m FROM lh), kw),
ln AS (SELECT geonameid, {_N.format(21)} % 40 AS alt_name_length, CASE WHEN {_N.format(29)} % 8 = 0 THEN {_sql_part(3, HOT, str(len(HOT)))} || ' ' || word ELSE word END AS name FROM lw),
lr AS (SELECT DISTINCT geonameid, alt_name_length, unnest(flatten([[lower(array_to_string(string_split(n, ' ')[a:b], ' ')) for b in range(a, 4) if b <= len(string_split(n, ' '))] for a in range(1, 4)])) AS phrase
  FROM (SELECT geonameid, alt_name_length, unnest([name, name || 'burg', 'Port ' || name]) AS n FROM ln)),
lq AS (SELECT unnest([{", ".join(f"'{x}'" for x in HOT)}] || known || [('North ' || x) for x in known]) AS query FROM kw),
lx AS (SELECT query, geonameid, row_number() OVER (PARTITION BY query ORDER BY alt_name_length DESC, geonameid) - 1 AS slot FROM lq JOIN lr ON lr.phrase = lower(query))
SELECT query, slot::INT AS slot, geonameid FROM lx WHERE slot < 6"""

"""Tables for the registered queries: a gazetteer derived from the benchmark's words, mentions in the documents, and small literal fixtures.

Each comes with its SQL, which DuckDB runs on the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import mentions as mn

#: Words that begin sentences rather than name places.
STOP = "the of and in to is that it for was on are with this be by from an at as die der und la el los las les le de en un une ein im".split()
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hex(at: int, n: int = 4) -> Column:
    return F.conv(F.substring("h", at, n), 16, 10).cast("long")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries for each capitalised ASCII word of the benchmark, with attributes from the md5 of word and number."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).where(F.col("w").rlike("^[A-Z][a-z]{2,}$") & ~F.lower("w").isin(STOP)).distinct()
    rows = words.select("w", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("i")).withColumn("h", F.md5(F.concat("w", F.lit("|"), F.col("i").cast("string"))))
    kind = _hex(5, 2) % 6
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    alts = F.array_distinct(F.transform(F.sequence(F.lit(0), (_hex(7, 1) % 4).cast("int")), lambda k: F.concat(F.col("w"), pick(k, ["", "burg", " Old Town", "ia"]))))
    return rows.select(
        _hex(1, 7).cast("string").alias("geonameid"), F.concat(pick(F.col("i"), ["", "", "North "]), F.col("w"), pick(F.col("i"), ["", " Heath", ""])).alias("name"), F.col("w").alias("asciiname"), alts.alias("alternativenames"),
        (_hex(9, 3) / 22.75 - 90).alias("lat"), (_hex(12, 3) / 11.375 - 180).alias("lon"), pick(kind, list("PAPSAP")).alias("feature_class"), pick(kind, ["PPL", "ADM1", "PPLX", "SQR", "PCLI", "PPLA"]).alias("feature_code"),
        pick(_hex(15, 2) % 5, ["USA", "DEU", "NLD", "FRA", "SYR"]).alias("country_code3"), (_hex(17, 2) % 9).cast("string").alias("admin1_code"), F.when(_hex(17, 2) % 9 == 0, "").otherwise(F.concat(F.lit("Province "), (_hex(17, 2) % 9).cast("string"))).alias("admin1_name"),
        (_hex(19, 2) % 7).cast("string").alias("admin2_code"), F.lit("").alias("admin2_name"), F.lit("").alias("admin3_code"), F.lit("").alias("admin4_code"), _hex(21, 5).alias("population"), F.size(alts).alias("alt_name_length"), F.to_date(F.lit("2024-01-01")).alias("modification_date"),
    )


def _h(at: int, n: int = 4) -> str:
    return f"('0x' || substr(h, {at}, {n}))::BIGINT"


def _p(at: str, values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{at} + 1]"


GAZETTEER = f"""gw AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND lower(w) NOT IN ({_STOP_SQL})),
gh AS (SELECT w, i, md5(w || '|' || i) AS h FROM gw, (VALUES (0), (1), (2)) t(i)),
ga AS (SELECT *, list_distinct([w || {_p("k", ["", "burg", " Old Town", "ia"])} for k in range(0, {_h(7, 1)} % 4 + 1)]) AS alts, {_h(5, 2)} % 6 AS kind FROM gh),
gaz AS (SELECT ({_h(1, 7)})::VARCHAR AS geonameid, {_p("i", ["", "", "North "])} || w || {_p("i", ["", " Heath", ""])} AS name, w AS asciiname, alts AS alternativenames, {_h(9, 3)} / 22.75::DOUBLE - 90 AS lat, {_h(12, 3)} / 11.375::DOUBLE - 180 AS lon,
  {_p("kind", list("PAPSAP"))} AS feature_class, {_p("kind", ["PPL", "ADM1", "PPLX", "SQR", "PCLI", "PPLA"])} AS feature_code, {_p(f"{_h(15, 2)} % 5", ["USA", "DEU", "NLD", "FRA", "SYR"])} AS country_code3,
  ({_h(17, 2)} % 9)::VARCHAR AS admin1_code, if({_h(17, 2)} % 9 = 0, '', 'Province ' || {_h(17, 2)} % 9) AS admin1_name, ({_h(19, 2)} % 7)::VARCHAR AS admin2_code, {_h(21, 5)} AS population, len(alts)::INT AS alt_name_length FROM ga),
gnames AS (SELECT DISTINCT geonameid, ' ' || trim(regexp_replace(lower(n), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS n FROM (SELECT geonameid, unnest(list_concat([name, asciiname], alternativenames)) AS n FROM gaz))"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that are entries' plain names: doc_id, mention_id (in order, from 0), search_name, start_char, end_char, in_rel (none)."""
    names = gazetteer(spark, sf_dir).select("asciiname").distinct()
    words = mn.pieces(read(spark, sf_dir, "documents")).join(names, F.col("piece") == F.col("asciiname"))
    own = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("own"))
    return own.select("doc_id", F.posexplode("own").alias("mention_id", "m")).select("doc_id", "mention_id", F.col("m.piece").alias("search_name"), F.col("m.start").cast("int").alias("start_char"), (F.col("m.start") + F.length("m.piece")).cast("int").alias("end_char"), F.lit("").alias("in_rel"))


_PIECES = r"""pcs AS (SELECT doc_id, i, ps[i] AS piece, if(i = 1, 0, list_sum([length(x) for x in ps[1:i - 1]])) AS start FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+|\P{L}+') AS ps FROM documents)))"""
PIECES = r"""ps AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+|\P{L}+') AS ps FROM documents), pu AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM ps),
pcs AS (SELECT doc_id, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pu)"""
MENTIONS = f"""{PIECES},
men AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS mention_id, piece AS search_name, start::INT AS start_char, (start + length(piece))::INT AS end_char FROM pcs WHERE piece IN (SELECT asciiname FROM gaz))"""

#: Names to search, some with no entry, some misspelt; the words stand in the benchmark at any scale factor or not.
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query: plain names of entries, the same with a letter more, and with a word that cleaning takes out."""
    g = gazetteer(spark, sf_dir).select("asciiname").distinct()
    return g.select(F.explode(F.array(F.col("asciiname"), F.concat("asciiname", F.lit("q")), F.concat(F.lit("North "), F.col("asciiname")))).alias("query"))


NAMES = "names AS (SELECT DISTINCT unnest([asciiname, asciiname || 'q', 'North ' || asciiname]) AS query FROM gaz)"
SEARCH = "hits AS (SELECT query, geonameid, alt_name_length, row_number() OVER (PARTITION BY query ORDER BY alt_name_length DESC, geonameid) - 1 AS slot FROM (SELECT DISTINCT query, g.geonameid, alt_name_length {more} FROM {names} JOIN gnames n ON contains(n.n, ' ' || trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ') JOIN gaz g ON n.geonameid = g.geonameid {where}))"


def literal(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """Rows of a VALUES list; the same text serves as SQL."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


PLACES = "('Quezon City'), ('US'), ('Kent county''s'), ('theodore'), ('the Hague'), ('The Hague'), ('Northern Territory'), ('Arghistan district'), ('tribal district Area'), ('Region'), ('New York City'), ('Homs Province'), ('')"
EVENT_GEO = (
    "(1, 0, 5, 1, 'A', 'P', 'PPL', 3), (2, 10, 20, 1, 'A', 'P', 'PPL', 3), (3, 50, 60, 1, 'A', 'P', 'PPL', 3), (3, 50, 60, 2, 'A', 'A', 'ADM1', 9), (4, 50, 60, 1, 'A', 'P', 'PPL', 3), (4, 50, 60, 2, 'B', 'P', 'PPL', 9), "
    "(5, 0, 20, 1, 'C', 'A', 'PCLI', 3), (5, 0, 20, 2, 'B', 'P', 'PPL', 9), (6, 0, 20, 1, 'C', 'A', 'PCLI', 3), (6, 0, 20, 2, 'D', 'A', 'ADM1', 20), (7, 5, 9, 1, 'E', 'S', 'SQR', 9), (7, 5, 9, 2, 'F', 'P', 'PPL', 10), (8, 5, 9, 1, 'E', 'S', 'SQR', 5)"
)
EVENT_COLUMNS = "event_id, qs, qe, k, name, feature_class, feature_code, start_char"

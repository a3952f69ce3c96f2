"""Content-addressed WARC archive (10).

An archive is a folder of two tables. payloads: each distinct payload of responses once, under its
SHA-256, which is recomputed when it is read. records: each record's exact WARC and HTTP header
bytes, with the digest that joins it to its payload. A record's original bytes are
header block, empty line, HTTP head and payload (response) or HTTP head alone (revisit), and two line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.common import hot_keys, join_hot, shared_dir, stored

CRLF = "\r\n"
#: Payloads shorter than this are stored by each record and never revisited.
LEAST = 100
PAYLOADS = "digest string, payload binary"
RECORDS = "page_id long, header binary, http binary, digest string, is_response boolean"


def _utf8(*parts: Column | str) -> Column:
    return F.encode(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)), "UTF-8")


def _one_line(c: Column) -> Column:
    """Header values can't hold line ends."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")


def record_id(page_id: Column) -> Column:
    """A UUID made of the page's id, so that a rerun writes the same bytes."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write a record per row of pages (page_id, url, html).

    A null html is the empty payload, a null url an empty target. Of the rows with equal payloads of at
    least `least` bytes, one with the smallest page_id (null ids last) is the response; rows with that very
    id repeated are all responses. Only digests are grouped, with partial sums, and joins by digest spread
    hot ones over tasks, so a payload that a third of all pages share is no task's alone. Other columns are not read; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _one_line(F.col("url")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    facts = rows.select("page_id", "url", "digest", "n")
    spark = pages.sparkSession
    facts = stored(facts, "facts")  # all but the payloads, so those are hashed once here
    firsts = facts.where(F.col("n") >= least).groupBy("digest").agg(F.min(F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("first"))
    marked = join_hot(facts, firsts, "digest", hot_keys(facts, "digest"), "page_id", "left")
    response = F.col("first").isNull() | (F.coalesce("page_id", F.lit((1 << 63) - 1)) == F.col("first"))
    marked = marked.withColumn("is_response", response)
    http = _utf8("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", F.col("n").cast("string"), CRLF + CRLF)
    marked = marked.withColumn("http", http)
    length = F.octet_length("http") + F.when(F.col("is_response"), F.col("n")).otherwise(0)
    header = _utf8(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(F.col("is_response"), "response").otherwise("revisit"), CRLF + "WARC-Record-ID: ", record_id(F.col("page_id")),
        CRLF + f"WARC-Date: {date}" + CRLF + "WARC-Target-URI: ", F.col("url"), CRLF + "WARC-Payload-Digest: sha256:", F.col("digest"),
        F.when(F.col("is_response"), "").otherwise(F.concat(F.lit(CRLF + "WARC-Refers-To: "), record_id(F.col("first")), F.lit(CRLF + "WARC-Refers-To-Page: "), F.col("first").cast("string"), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: ", length.cast("string"), CRLF + CRLF,
    )
    marked.select("page_id", header.alias("header"), "http", "digest", "is_response").write.option("compression", "zstd").parquet(f"{path}/records")
    last = F.lit((1 << 63) - 1)  # stands for a null page_id
    kept = spark.read.schema(RECORDS).parquet(f"{path}/records").where("is_response").groupBy("digest", F.coalesce("page_id", last).alias("first")).count()
    once = kept.groupBy("digest").agg(F.min("first").alias("first"), F.min_by("count", "first").alias("copies"))
    holders = rows.select("digest", "payload", F.coalesce("page_id", last).alias("first")).join(once.hint("merge"), ["digest", "first"])  # as large as the pages: never broadcast
    repeated = holders.where("copies > 1").groupBy("digest").agg(F.first("payload").alias("payload"))
    holders.where("copies = 1").select("digest", "payload").unionByName(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, n (bytes), verified: the stored payloads with their digests recomputed."""
    df = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    return df.withColumns({"n": F.octet_length("payload").cast("long"), "verified": F.sha2("payload", 256) == F.col("digest")})


def field(name: str) -> Column:
    """The value of a header line, null where there is none."""
    text = F.decode("header", "UTF-8")
    return F.when(text.contains(f"{CRLF}{name}: "), F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS with record_type, payload_digest, refers_to as parsed from the header bytes."""
    df = spark.read.schema(RECORDS).parquet(f"{path}/records")
    return df.withColumns({"record_type": field("WARC-Type"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""), "refers_to": field("WARC-Refers-To-Page").cast("long")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes, verified, record: each record with its original bytes.

    Payload facts of a revisit come from the stored payload too; its bytes do not, as its block is the HTTP head alone.
    """
    heads, store = read_headers(spark, path), read_payloads(spark, path).withColumnRenamed("digest", "payload_digest")
    hot = hot_keys(heads, "payload_digest")
    end, facts = F.encode(F.lit(CRLF * 2), "UTF-8"), ("page_id", "record_type", "refers_to", "payload_digest", F.col("n").alias("payload_bytes"), "verified")
    full = join_hot(heads.where("is_response"), store, "payload_digest", hot, "page_id", "left").select(*facts, F.concat("header", "http", "payload", end).alias("record"))
    return full.unionByName(join_hot(heads.where("not is_response"), store.drop("payload"), "payload_digest", hot, "page_id", "left").select(*facts, F.concat("header", "http", end).alias("record")))


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages as an archive in the shared folder, read it back and return a row per page from what was read.

    page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes, record_sha256, verified.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc"
    write_archive(pages, path, least=least)
    df = read_records(pages.sparkSession, path)
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), "verified")


_ID = "'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
#: The query op10_warc in DuckDB.
SQL = rf"""
WITH d AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') AS url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, n < {LEAST} OR page_id = min(page_id) OVER (PARTITION BY digest) AS response FROM d),
g AS (SELECT *, md5('page ' || page_id) AS h, md5('page ' || first) AS fh, E'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ' || n || E'\r\n\r\n' AS http FROM f),
r AS (SELECT *, E'WARC/1.1\r\nWARC-Type: ' || if(response, 'response', 'revisit') || E'\r\nWARC-Record-ID: ' || {_ID.format(h="h")} || E'\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: ' || url || E'\r\nWARC-Payload-Digest: sha256:' || digest
  || if(response, '', E'\r\nWARC-Refers-To: ' || {_ID.format(h="fh")} || E'\r\nWARC-Refers-To-Page: ' || first || E'\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest')
  || E'\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ' || (strlen(http) + if(response, n, 0)) || E'\r\n\r\n' || http || if(response, html, '') || E'\r\n\r\n' AS record FROM g)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, if(response, 'response', 'revisit') AS record_type, if(response, NULL, first) AS refers_to,
  strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256, true AS verified FROM r
"""

"""Mixing sources to target weights (6) by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is target / available amount. Each document draws its number of
copies from a Poisson distribution of that mean, by inverting it at a uniform number that is a
hash of seed and document, so a rerun draws the same. Copies are exploded and shuffled globally
by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import partitions

#: Means above this are drawn as sums of equal smaller ones: exp(-mean) stays far from underflow and tables short.
PART = 16.0
#: Entries of a distribution table; at PART the rest is below 1e-16.
TABLE = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' md5; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, total: float | None = None, size: Column | None = None) -> DataFrame:
    """source, available, rate: the mean repetitions that bring each source to its share of the total.

    weights give sources' shares before normalising; a source without one has default. total is the
    wanted amount (that of docs, if None); size is each row's amount (1 a document, if None). A null
    source is a source of its own, null. Sources with weight 0, or none available, have rate 0.
    """
    n = F.sum((F.lit(1) if size is None else F.coalesce(size, F.lit(0))).cast("double"))
    by = docs.groupBy(F.col("source").cast("string").alias("source")).agg(n.alias("available"))
    weight = F.lit(float(default))
    for k, v in (weights or {}).items():
        weight = F.when(F.col("source") == k, F.lit(float(v))).otherwise(weight)
    by = by.withColumn("weight", F.when(F.col("available") > 0, weight).otherwise(F.lit(0.0)))
    sums = by.agg(F.sum("weight").alias("weights"), F.sum("available").alias("everything")).first()
    want = F.lit(float(sums.everything or 0.0) if total is None else float(total))
    return by.select("source", "available", F.when(F.col("weight") > 0, want * F.col("weight") / F.lit(float(sums.weights or 1.0)) / F.col("available")).otherwise(0.0).alias("rate"))


def tables(by: DataFrame) -> DataFrame:
    """by with parts (the equal means that rate is cut into) and cdf (P(copies <= k) for one part)."""
    by = by.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    step = lambda acc, k: F.struct((acc.p * F.col("mean") / k).alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * F.col("mean") / k)).alias("cdf"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    return by.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), first, step).cdf)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, total: float | None = None, seed: int = 17, size: Column | None = None, max_sources: int = 10_000) -> DataFrame:
    """All columns of docs, then mix_rate, mix_copies, mix_copy (from 1), mix_key: a row per copy, globally shuffled.

    A row's place in the global order is mix_key, a hash of seed, document and copy; partitions hold
    rows dealt out by it, each sorted. Rows with equal doc_id draw the same number, so repeated rows
    repeat alike; a null doc_id draws as the string null. Columns of docs named like the four are
    replaced, all others stay, whatever their names. Texts are not looked at. An empty table gives none. The rates go to all executors only
    if there are at most max_sources sources; otherwise they are joined by source.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    mark = next(m for k in range(len(docs.columns) + 1) if not any(c.lower().startswith(m := f"mix{'_' * (k + 2)}") for c in docs.columns))
    source, parts, cdf, u = (f"{mark}{x}" for x in ("source", "parts", "cdf", "u"))  # names that no column of docs has
    by = tables(rates(docs, weights, default, total, size)).select(F.col("source").alias(source), F.col("rate").alias("mix_rate"), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    few = docs.select("source").distinct().limit(max_sources + 1).count() <= max_sources
    by = F.broadcast(by) if few else by
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = lambda acc, j: acc + F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(str(seed)), doc, j.cast("string"))))
    n = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), draw)
    df = docs.join(by, F.col("source").cast("string").eqNullSafe(F.col(source)))
    df = df.withColumn(u, uniform(F.lit(str(seed)), doc, F.lit("1"))).withColumn("mix_copies", F.when(F.col(parts) == 1, F.size(F.filter(cdf, lambda c: c <= F.col(u)))).otherwise(n))
    df = df.where(F.col("mix_copies") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    df = df.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), doc, F.col("mix_copy").cast("string"))))
    return df.select(*docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key").repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


#: The query op6_mix_sources with its defaults in DuckDB: equal weights, seed 17.
SQL = f"""
WITH RECURSIVE by_source AS (
  SELECT source, count(*)::DOUBLE AS available, (SELECT count(*)::DOUBLE FROM documents) * 1.0 / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) / count(*)::DOUBLE AS rate FROM documents GROUP BY source
), parts AS (SELECT *, greatest(1, ceil(rate / {PART}))::INT AS parts FROM by_source),
term AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf FROM parts
  UNION ALL
  SELECT t.source, k + 1, p * (rate / parts) / (k + 1), cdf + p * (rate / parts) / (k + 1) FROM term t JOIN parts q ON t.source IS NOT DISTINCT FROM q.source WHERE k < {TABLE}
), tables AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM term GROUP BY source),
drawn AS (
  SELECT d.*, q.rate AS mix_rate, list_sum([len(list_filter(t.cdfs, lambda c: c <= ('0x' || substr(md5(concat_ws('|', '17', coalesce(d.doc_id::VARCHAR, 'null'), j::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0)) for j in range(1, q.parts + 1)])::INT AS mix_copies
  FROM documents d JOIN parts q ON d.source IS NOT DISTINCT FROM q.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (SELECT *, unnest(range(1, mix_copies + 1))::INT AS mix_copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, round(mix_rate, 9) AS mix_rate, mix_copies, mix_copy, md5(concat_ws('|', 'order 17', coalesce(doc_id::VARCHAR, 'null'), mix_copy::VARCHAR)) AS mix_key FROM copies
"""

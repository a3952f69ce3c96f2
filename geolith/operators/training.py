"""Training data from annotated corpora, splits, labels, and a trainable linear ranker."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.operators.features import FEATURES
from geolith.sources.scratch import stored


def from_options(rows: DataFrame) -> DataFrame:
    """Answers picked from options (text, answer, accept, options(id, text), spans(start, end)) -> text, start, end, gold_id.

    Only accepted rows with an option whose text ends in the entry's number.
    """
    ok = rows.where("answer = 'accept' AND size(accept) > 0")
    one = ok.withColumn("option", F.get(F.filter("options", lambda o: o.id.cast("string") == F.get("accept", F.lit(0)).cast("string")), F.lit(0)).text)
    gold = F.regexp_extract("option", r"(\d+)$", 1)
    return one.select("text", F.get("spans", F.lit(0)).start.alias("start"), F.get("spans", F.lit(0)).end.alias("end"), gold.alias("gold_id")).where("gold_id <> ''")


def from_sentences(rows: DataFrame) -> DataFrame:
    """Rows with one right entry and offsets in a sentence or the document -> text, start, end, gold_id; a sentence's offsets come first."""
    at = lambda k: F.coalesce(*(F.col(c) for c in (f"{k}_char_sent", f"{k}_char_doc") if c in rows.columns))
    return rows.select("text", at("start").alias("start"), at("end").alias("end"), F.col("correct_geonamesid").cast("string").alias("gold_id"))


#: Of each kind of toponym corpus, the fields of the id and of the name.
TOPONYM_FIELDS = {"tr": ("gaztag._geonameid", "phrase"), "lgl": ("gaztag._geonameid", "phrase"), "gwn": ("geonamesID", "extractedName"), "synth": ("geonamesID", "placename")}


def from_toponyms(articles: DataFrame, source: str) -> DataFrame:
    """Articles with toponyms.toponym arrays -> text, start, end, name, gold_id."""
    gold, name = TOPONYM_FIELDS[source]
    each = articles.select("text", F.explode("toponyms.toponym").alias("t"))
    return each.select("text", F.col("t.start").cast("int").alias("start"), F.col("t.end").cast("int").alias("end"), F.col(f"t.{name}").alias("name"), F.col(f"t.{gold}").cast("string").alias("gold_id")).where("gold_id IS NOT NULL AND gold_id <> ''")


def attach_gold(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """mentions with gold_id of the annotation (doc_id, start, end) that they are the first to start in, null for the rest.

    A join by document with a test of the range, and the first mention of each annotation.
    """
    hits = mentions.join(gold, "doc_id").where((F.col("start_char") >= F.col("start")) & (F.col("start_char") < F.col("end")))
    w = Window.partitionBy("doc_id", "start", "end").orderBy("start_char", "mention_id")
    first = hits.withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("doc_id", "mention_id").agg(F.min("gold_id").alias("gold_id"))
    return mentions.join(first, ["doc_id", "mention_id"], "left")


def labelled_only(rows: DataFrame) -> DataFrame:
    """After coherence has seen all mentions, those with a gold entry."""
    return rows.where("gold_id IS NOT NULL")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with row_number, from 0 in an order over all: sorted by range, numbered within partitions, with the partitions' sizes added. No task sees all rows; the driver gets a number a partition."""
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    parts = parts.withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    start = F.get(F.array(*map(F.lit, before)), F.col("_part").cast("int")) if before else F.lit(0)
    return parts.withColumn("row_number", F.col("_in") + start).drop("_part", "_in")


def head_tail(rows: DataFrame, share: float, order: str) -> tuple[DataFrame, DataFrame]:
    """The first round(share * n) rows by order, and the rest."""
    n, every = round(share * rows.count()), numbered(rows, order)
    return every.where(F.col("row_number") < n).drop("row_number"), every.where(F.col("row_number") >= n).drop("row_number")


def split_mark(rows: DataFrame, share: float, order: str, *groups: str) -> DataFrame:
    """rows with is_train, the first round(share * n) of each group by order; nulls come last.

    The share counts as the decimal it is written as, and halves are rounded up: 0.7 * 45 is 31.5, not a little less.
    """
    w = Window.partitionBy(*groups)
    first = F.round(F.count("*").over(w) * F.lit(Decimal(str(share))))
    return rows.withColumn("is_train", F.row_number().over(w.orderBy(F.asc_nulls_last(order))) <= first).select(*rows.columns, "is_train")


def shuffled(rows: DataFrame, key: str, seed: int = 617, n: int | None = None) -> DataFrame:
    """Rows in the order of a seeded hash of their key, or the first n of them."""
    order = (F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.col(key))
    return rows.orderBy(*order) if n is None else numbered(rows, *order).where(F.col("row_number") < n).drop("row_number")


def sound(rows: DataFrame, tensor: str = "tensor") -> DataFrame:
    """Rows whose vector is not degenerate."""
    return rows.where(F.size(tensor) > 1)


def labels(rows: DataFrame, slots: int) -> DataFrame:
    """doc_id, mention_id, label (the right slot, the last without any), country (of the right candidate, or NULL)."""
    by = rows.where(F.col("slot") < slots).groupBy("doc_id", "mention_id").agg(F.min(F.when(F.col("is_correct"), F.col("slot"))).alias("slot"), F.min_by("country_code3", F.when(F.col("is_correct"), F.col("slot"))).alias("c"))
    return by.select("doc_id", "mention_id", F.coalesce("slot", F.lit(slots - 1)).alias("label"), F.when(F.col("slot").isNotNull(), F.col("c")).otherwise("NULL").alias("country"))


def fit_linear(rows: DataFrame, rounds: int = 40, rate: float = 0.5, penalty: float = 1e-3) -> tuple[float, ...]:
    """Weights for linear_scores by gradient descent on the log loss of the right candidate (rows: FEATURES, is_correct).

    Each round is one pass of a distributed sum; the driver sees nine numbers. Features are divided by their deviation.
    """
    every = rows.select("doc_id", "mention_id", F.col("is_correct").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in FEATURES))
    scale = [float(x or 1.0) or 1.0 for x in every.agg(*(F.stddev(c) for c in FEATURES)).first()]
    by = Window.partitionBy("doc_id", "mention_id")
    own = every.withColumn("_has", F.max("y").over(by)).where("_has > 0").drop("_has").cache()  # dealt and sorted by mention, as the rounds need it
    n, w = max(1, own.select("doc_id", "mention_id").distinct().count()), [0.0] * len(FEATURES)
    for _ in range(rounds):
        logit = sum((F.col(c) * (x / s) for c, x, s in zip(FEATURES, w, scale)), F.lit(0.0))
        e = own.withColumn("_e", F.exp(logit))
        diff = F.col("y") - F.col("_e") / F.sum("_e").over(by)
        g = e.withColumn("_d", diff).agg(*(F.sum(F.col("_d") * F.col(c) / s) for c, s in zip(FEATURES, scale))).first()
        w = [x + rate * (float(d or 0.0) / n - penalty * x) for x, d in zip(w, g)]
    own.unpersist()
    return tuple(x / s for x, s in zip(w, scale))


#: Fixed: the kinds of annotated corpora, by source.
SOURCES = {"tr": "toponyms", "lgl": "toponyms", "gwn": "toponyms", "gwn_complete": "toponyms", "synth": "toponyms", "syn_cities": "toponyms", "syn_caps": "toponyms", "prodigy": "options", "wiki": "sentences", "wiki_incorrect": "sentences"}


def annotations(rows: DataFrame, source: str) -> DataFrame:
    """text, start, end, gold_id of a source's corpus, by its layout."""
    kind = SOURCES[source]
    if kind == "toponyms":
        own = from_toponyms(rows, source if source in TOPONYM_FIELDS else "gwn" if source.startswith("gwn") else "synth")
    else:
        own = from_options(rows) if kind == "options" else from_sentences(rows)
    return own.select("text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "gold_id")


def parsed_documents(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of a source's distinct texts, and their annotations by doc_id (doc_id, start, end, gold_id). doc_id is the order of the texts' digests, so a rerun gives the same."""
    own = annotations(rows, source).withColumn("text_key", F.sha2("text", 256))
    texts = numbered(own.groupBy("text_key").agg(F.first("text").alias("text")), "text_key").withColumnRenamed("row_number", "doc_id")
    gold = own.join(texts.select("text_key", "doc_id"), "text_key").select("doc_id", "start", "end", "gold_id")
    return texts.select("doc_id", "text"), gold

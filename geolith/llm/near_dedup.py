"""MinHash near-dedup (9) with odd sketches.

Each document's set of word shingles gives MinHash samples. Bands of samples bring likely
duplicates together; an odd sketch, the samples folded into a bitmap of parities, has an XOR whose
population count estimates a high similarity, and throws out most false candidates; links are
confirmed on the full sets. Equal sets are collapsed first: only the smallest doc_id of a class goes on.

Within a band's group all pairs are never made. The first round compares one document of each
group, that whose bands have the most documents, with the others and joins what links; groups whose members are all connected are done.
What is left are mostly documents that share a common passage and little else. They are grouped
anew, by the rarest shingles of each, so few that two documents which link must share one (prefix
filtering): common passages bring no one together there. Rounds then take a few centres of each
such group, compare them with the members that are not connected with them yet, if as much could
still be shared from that shingle on as a link takes, and drop the used centres. In the end each pair of a band's group was compared, cannot link, or is connected
anyway, so components are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import give_back, hot_keys, join_hot, stored, text_column
from geolith.llm.words import U, Words, mixed, pieces

#: Samples in a band, and bands: at similarity 0.8 a pair shares no band with probability 6e-7.
ROWS, BANDS = 5, 36
ODD_BITS = 512
SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<long>, odd array<long>"
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, ROWS * BANDS, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, np.uint32)
_C = _RNG.integers(0, 1 << 63, ROWS, np.uint64) | U(1)


def shingle_sets(column: pa.Array, shingle: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, 64-bit shingle hash), ordered by both. A text of fewer words than a shingle is one shingle; without words it has none."""
    w = Words(column, lower)
    text, left = w.text_of(), w.left()
    full = np.flatnonzero(left >= shingle)
    short = w.first[:-1][(w.counts > 0) & (w.counts < shingle)]
    n = w.counts[text[short]]
    h = np.concatenate([w.runs(full, shingle), mixed(w.runs(short, n) + n.astype(U))])
    text = np.concatenate([text[full], text[short]])
    if len(w.counts) == 1:
        h = np.unique(h)
        return np.zeros(len(h), np.int64), h
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]
    return text[new], h[new]


def minhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(samples, sets): the least of each permuted hash in each set; sets start at first."""
    x, out = (h >> U(32)).astype(np.uint32), np.empty((len(_A), len(first)), np.uint32)
    for i in range(len(_A)):
        np.minimum.reduceat(x * _A[i] + _B[i], first, out=out[i])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, bands): a 64-bit key of each band's samples, different from band to band."""
    s = samples.astype(U).reshape(BANDS, ROWS, -1)
    key = (mixed(s + np.arange(1, ROWS + 1, dtype=U)[:, None]) * _C[:, None]).sum(axis=1, dtype=U)
    return mixed(key + np.arange(1, BANDS + 1, dtype=U)[:, None] * U(0x9E3779B97F4A7C15)).T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, ODD_BITS / 64): parities of the samples, each a set element of its place and value."""
    k, n = samples.shape
    bit = mixed(samples.astype(U) + (np.arange(1, k + 1, dtype=U) << U(32))[:, None]) % U(ODD_BITS)
    count = np.bincount((bit + np.arange(n, dtype=U) * U(ODD_BITS)).ravel().astype(np.int64), minlength=n * ODD_BITS)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64).reshape(n, ODD_BITS // 64)


def odd_limit(similarity: float) -> int:
    """XOR bits that pairs of at least that similarity exceed with negligible probability: six deviations of the samples and six of the parities."""
    k = ROWS * BANDS
    differ = k * (1 - similarity) + 6 * math.sqrt(k * similarity * (1 - similarity))
    p = (1 - math.exp(-4 * differ / ODD_BITS)) / 2
    return math.ceil(ODD_BITS * p + 6 * math.sqrt(ODD_BITS * p * (1 - p)))


def similarity_of(odd_a: Column, odd_b: Column) -> Column:
    """The odd sketch's estimate of two sets' similarity."""
    return 1 + ODD_BITS / (4.0 * ROWS * BANDS) * F.log(F.greatest(F.lit(1e-3), 1 - 2 * _xor(odd_a, odd_b) / ODD_BITS))


def _xor(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """SKETCH: set size n, a 128-bit digest of the set, band keys and odd sketch; a set without shingles has digest 0 and no bands."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(1)):
                text, h = shingle_sets(part, shingle)
                n = np.bincount(text, minlength=len(part))
                own = np.flatnonzero(n)
                s1, s2 = np.zeros(len(part), U), np.zeros(len(part), U)
                bands, odd = np.zeros((len(own), BANDS), U), np.zeros((len(own), ODD_BITS // 64), np.int64)
                if len(own):
                    first = (np.cumsum(n) - n)[own]
                    s1[own], s2[own] = np.add.reduceat(mixed(h), first), np.add.reduceat(mixed(h ^ U(0x5851F42D4C957F2D)), first)
                    m = minhashes(h, first)
                    bands, odd = band_keys(m), odd_sketches(m)
                lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * k)]).astype(np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists(bands, BANDS), lists(odd, ODD_BITS // 64)], ["doc_id", "n", "s1", "s2", "bands", "odd"])
        give_back()

    return text_column(docs, "doc_id", "text").mapInArrow(go, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets have 100 * intersection >= percent * union. texts: doc, text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(2)):
                (ta, ha), (tb, hb) = shingle_sets(part, shingle), shingle_sets(batch.column(3).slice(start, len(part)), shingle)
                if len(part) == 1:  # perhaps long ones
                    both = np.array([np.count_nonzero(hb[np.minimum(np.searchsorted(hb, ha), len(hb) - 1)] == ha) if len(hb) else 0])
                    keep = pa.array((100 * both >= percent * (len(ha) + len(hb) - both)) & (both > 0))
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, 1).filter(keep) for k in (0, 1)], ["a", "b"])
                    continue
                t, h = np.concatenate([ta, tb]), np.concatenate([ha, hb])
                order = np.lexsort((h, t))
                t, h = t[order], h[order]
                both = np.bincount(t[1:][(t[1:] == t[:-1]) & (h[1:] == h[:-1])], minlength=len(part)) if len(t) else np.zeros(len(part), int)
                union = np.bincount(t, minlength=len(part)) - both
                keep = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, len(part)).filter(keep) for k in (0, 1)], ["a", "b"])
        give_back()

    own = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(go, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc, comp (the least doc reachable) for every end of an edge (a, b): least labels travel along edges, and labels' labels are taken over, until none changes."""
    both = stored(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "edges")
    labels = stored(both.groupBy(F.col("src").alias("doc")).agg(F.min("dst").alias("m")).select("doc", F.least("doc", "m").alias("comp")), "labels")
    total = lambda df: df.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    before = None
    while before != (now := total(labels)):
        before = now
        near = both.join(labels.select(F.col("doc").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("doc")).agg(F.min("comp").alias("m"))
        up = labels.join(near, "doc", "left").select("doc", F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("top"))
        labels = stored(up.join(jump, "comp").select("doc", F.least("comp", "top").alias("comp")), "labels")
    return labels


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels (doc, comp) after more edges (a, b): only the components that the new edges touch are looked at again."""
    if labels is None:
        return components(edges)
    of = lambda x: labels.select(F.col("doc").alias(x), F.col("comp").alias(f"comp_{x}"))
    named = stored(edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b")), "ends")
    between = named.where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
    if between.isEmpty():
        return labels
    up = components(between).select(F.col("doc").alias("comp"), F.col("comp").alias("top"))
    new = named.select(F.col("a").alias("doc")).unionByName(named.select(F.col("b").alias("doc"))).distinct().join(labels, "doc", "left_anti").withColumn("comp", F.col("doc"))
    every = labels.select("doc", "comp").unionByName(new.select("doc", "comp"))
    return stored(every.join(up, "comp", "left").select("doc", F.coalesce("top", "comp").alias("comp")), "labels")


def rare_members(texts: DataFrame, shingle: int, percent: int, most: int = 200_000) -> DataFrame:
    """key, doc, left: the rarest n - ceil(percent * n / 100) + 1 shingles of each text (doc, text), in an order common to all, and how many shingles are left from each on.

    Any one order is exact. This one puts common shingles last: those in a thousandth of the texts or
    more, the `most` most common of them, by their count; so their list has a bound.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part, shingle)[1].view(np.int64))], ["key"])

    counts = texts.select("text").mapInArrow(sets, "key long").groupBy("key").count().where(F.col("count") >= max(2, texts.count() // 1000))
    common = counts.orderBy(F.col("count").desc(), "key").limit(most).toPandas()
    common = common.assign(key=common["key"].to_numpy(np.int64).view(U)).sort_values("key")
    shared = texts.sparkSession.sparkContext.broadcast((common["key"].to_numpy(), common["count"].to_numpy(np.int64)))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count = shared.value
        for batch in batches:
            for start, part in pieces(batch.column(1)):
                text, h = shingle_sets(part, shingle)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                c = np.where(keys[at] == h, count[at], 0) if len(keys) else np.zeros(len(h), np.int64)
                order = np.lexsort((h, c, text))
                n = np.bincount(text, minlength=len(part))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                wanted = n - -(-percent * n // 100) + 1
                keep = order[place < np.repeat(wanted, n)]
                left = (np.repeat(n, n) - place)[place < np.repeat(wanted, n)]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), batch.column(0).slice(start, len(part)).take(pa.array(text[keep])), pa.array(left.astype(np.int64))], ["key", "doc", "left"])

    return texts.select("doc", "text").mapInArrow(rare, "key long, doc long, left long")


def links(members: DataFrame, facts: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """doc, comp over members (key, doc, and size: rows of the key): components of all confirmed pairs that share a key; None if nothing links.

    facts: doc, n, odd; texts: doc, text. Centres of a round: one of each band's group, then 8, 64, ... of each rare shingle's.
    Joins by key spread the rows of hot groups over tasks; groups are otherwise only summed up in part before they are moved.
    """
    limit, tested = odd_limit(percent / 100), []
    a, b = (facts.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    labels = None

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.drop("comp")
        if labels is None:
            return rows.withColumn("comp", F.col("doc"))
        return rows.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))

    def compare(pairs: DataFrame) -> DataFrame | None:
        """labels after the pairs (c, c_comp, doc, comp) that are worth it were confirmed."""
        new = pairs.where(F.col("c_comp") != F.col("comp")).select(F.least("c", "doc").alias("a"), F.greatest("c", "doc").alias("b")).distinct()
        if tested:
            new = new.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        new = stored(new, "pairs")
        tested.append(new)
        alike = new.join(a, "a").join(b, "b").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_xor(F.col("odd_a"), F.col("odd_b")) <= limit)).select("a", "b")
        found = stored(confirmed(alike, texts, shingle, percent), "links")
        return labels if found.isEmpty() else joined(labels, found)

    hot = hot_keys(members, "key")
    # of near copies of one text, that text has the most common bands and links with all of them, while two copies need not link
    scored = members.withColumn("order", F.struct(F.sum("size").over(Window.partitionBy("doc")).alias("score"), (-F.col("doc")).alias("less")))
    centre = scored.groupBy("key").agg((-F.max("order").getField("less")).alias("c"))
    rest = stored(join_hot(members.select("key", "doc"), centre, "key", hot, "doc").where("doc <> c"), "members")
    labels = compare(rest.select("c", F.col("c").alias("c_comp"), "doc", F.col("doc").alias("comp")))
    rest = named(rest.select("key", "doc"))
    open_ = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    live = stored(join_hot(rest, open_, "key", hot, "doc").select("doc").distinct(), "live")
    live = stored(texts.join(live, "doc", "left_semi"), "unsettled")
    if live.isEmpty():
        return labels
    sizes = facts.select("doc", "n")
    rest, count = stored(rare_members(live, shingle, percent).join(sizes, "doc"), "rare"), 8
    hot = hot_keys(rest, "key")
    enough = (100 + percent) * F.least("left", "c_left") >= percent * (F.col("n") + F.col("c_n"))
    while True:
        rows = named(rest)
        # members that could not share enough with the smallest one of the group are done
        open_ = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least_n")).where("low < high").select("key", "least_n")
        rows = stored(join_hot(rows, open_, "key", hot, "doc").where((100 + percent) * F.col("left") >= percent * (F.col("n") + F.col("least_n"))).drop("least_n"), "members")
        if rows.isEmpty():
            return labels
        # members of small components come first: once they were centres, a group's largest component is alone
        rows = rows.withColumn("part", F.struct("key", "comp"))
        rows = join_hot(rows, rows.groupBy("part").agg(F.count("*").alias("size")), "part", hot_keys(rows, "part"), "doc")
        rows = rows.withColumn("order", F.struct("size", "comp", "doc")).drop("size", "part")
        order = Window.partitionBy("key").orderBy("order")  # limits run before rows are moved
        centres = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
        centres = stored(centres.select("key", "order", F.col("doc").alias("c"), F.col("comp").alias("c_comp"), F.col("left").alias("c_left"), F.col("n").alias("c_n")), "centres")
        last = centres.groupBy("key").agg(F.max("order").alias("last"))
        labels = compare(join_hot(rows, centres.drop("order"), "key", hot, "doc").where((F.col("c_comp") != F.col("comp")) & enough))
        rest = stored(join_hot(rows, last, "key", hot, "doc").where(F.col("order") > F.col("last")).drop("last", "order"), "members")
        count *= 8


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id): a row per row of docs.

    Words are runs of anything but ASCII white space, A-Z in lower case. Rows link if their sets'
    similarity is at least percent. Rows without words (or null) link with none: each is its own
    component. A null doc_id takes part as a copy of its class's least doc_id, or is alone with a null component, kept; rows with
    the same doc_id count as one document. Texts are never cut. Other columns are not read; an
    empty table gives none.
    """
    made = stored(sketches(docs, shingle), "sketches")
    full = made.where("n > 0").withColumn("set", F.struct("n", "s1", "s2"))
    classes = full.groupBy("set").agg(F.min("doc_id").alias("rep"))
    own = join_hot(full.drop("s1", "s2"), classes, "set", hot_keys(full, "set"), "doc_id")
    joined = stored(own.select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.struct("bands", "odd")).alias("own")), "classes")
    reps = joined.where("own is not null").select(F.col("doc_id").alias("doc"), "n", "own.bands", "own.odd")
    every = reps.select(F.explode("bands").alias("key"), "doc")
    shared = every.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    members = stored(every.join(shared, "key"), "members")
    labels = None
    if not members.isEmpty():
        some = stored(members.select("doc").distinct(), "candidates")
        texts = text_column(docs, "doc_id", "text").withColumnRenamed("doc_id", "doc").join(some, "doc", "left_semi")
        texts = stored(texts, "texts")
        facts = stored(reps.select("doc", "n", "odd").join(some, "doc", "left_semi"), "facts")
        labels = links(members, facts, texts, shingle, percent)
    rows = joined.select("doc_id", "n", "rep")
    if labels is not None:
        rows = join_hot(rows, labels.select(F.col("doc").alias("rep"), "comp"), "rep", hot_keys(rows, "rep"), "doc_id", "left").select("doc_id", "n", F.coalesce("comp", "rep").alias("component_id"))
    else:
        rows = rows.select("doc_id", "n", F.col("rep").alias("component_id"))
    rows = rows.unionByName(made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs: that with the least doc_id (null ids last, of equal ids the first).

    Rows are told apart by their places, not by doc_id: repeated ids with other texts and null ids count each for themselves.
    Rows without words stay, all of them.
    """
    row = next(m for k in range(len(docs.columns) + 1) if (m := f"row{'_' * (k + 1)}") not in [c.lower() for c in docs.columns])
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # the rows of a scan come in one order each time, those of a shuffle need not
        numbered = stored(numbered, "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), shingle, percent)
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    groups = stored(groups, "groups")
    best = groups.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.c").alias("row"))
    gone = groups.join(best, "row", "left_anti").select(F.col("row").alias(row))  # grows with the corpus: never broadcast
    return numbered.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)


#: The query op9_near_dedup in DuckDB: links by an inverted index over all shingles, then components.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] END) AS shingles FROM w),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
r(d, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.d = e.a),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN m ON s.doc_id = m.d
"""

"""Benchmark decontamination (2): one Aho-Corasick automaton over normalised windows of items.

Texts are taken as UTF-8 bytes: A-Z are lower-cased, all separators become one space, and each
word is between two spaces. A window of an item is n consecutive words, also between spaces; the
automaton over all distinct windows scans a text once. An occurrence's end gives its last word by
the spaces before it, and word numbers give offsets into the original.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import stored, text_column, texts_of

#: Fixed, for lower-cased texts: a word is a run of ASCII digits and letters and of all characters above U+007F.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
_LOWER = {x: x + 32 for x in range(65, 91)}
#: Text of the windows of one automaton, which takes some 50 times that much in each worker.
MAX_MB = 8
SCANNED = "doc_id long, n_words long, words array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(benchmark: DataFrame, n: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """window (its words between spaces, in Latin-1 of UTF-8), items (array of keys as strings, sorted): a row per distinct window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words = words_of(t)
                out += [(w, item) for w in {b" %b " % b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["window", "item"])

    rows = benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def automaton(rows: list[tuple[bytes, list[str]]]):
    """An automaton over windows; values are (number of words, items)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for window, items in rows:
        out.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
    if rows:
        out.make_automaton()
    return out


def occurrences(tree, text: str) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """The number of words of text, and for each occurrence its first word, the word after its last, and its items."""
    words = words_of(text)
    if not words or not len(tree):
        return len(words), []
    flat = b" %b " % b" ".join(words)
    found = list(tree.iter(flat.decode("latin-1")))
    if not found:
        return len(words), []
    spaces = np.cumsum(np.frombuffer(flat, np.uint8) == 32)
    return len(words), [(int(spaces[end]) - 1 - k, int(spaces[end]) - 1, items) for end, (k, items) in found]


_TREES: dict[str, object] = {}


def _tree(name: str, rows):
    """This worker's automaton of that name, built once; one of a block before makes room for it. rows: a broadcast list of windows."""
    if name not in _TREES:
        _TREES.clear()
        _TREES[name] = automaton(rows.value)
    return _TREES[name]


def scan(docs: DataFrame, rows: list[tuple[bytes, list[str]]], text: bool = False) -> DataFrame:
    """row, SCANNED, with text if asked for: the hit words and occurring items of each row (row, doc_id, text)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(name, shared)
        for batch in batches:
            n, hit, items = [], [], []
            for t in batch.column(2):
                k, found = occurrences(tree, t.as_py() or "")
                n.append(k)
                hit.append(sorted({w for i, j, _ in found for w in range(i, j)}))
                items.append(sorted({x for *_, own in found for x in own}))
            out = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out + [batch.column(2)] * text, ["row", "doc_id", "n_words", "words", "items"] + ["text"] * text)

    return docs.select("row", "doc_id", "text").mapInArrow(go, "row long, " + SCANNED + ", text string" * text)


def blocks(table: DataFrame, max_mb: int = MAX_MB) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The windows in lists of at most about max_mb MB of text: one, perhaps empty, for any usual benchmark.

    The driver holds one list at a time, and so does a worker; its automaton takes some 50 times its text.
    """
    out, size, any_ = [], 0, False
    for r in table.toLocalIterator():
        if size > max_mb << 20:
            yield out
            out, size, any_ = [], 0, True
        out.append((bytes(r.window), list(r.items)))
        size += len(r.window)
    if out or not any_:
        yield out


def scan_all(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_mb: int = MAX_MB, text: bool = False) -> DataFrame:
    """SCANNED over all windows. Of several blocks each scans the texts in place and keeps its hits alone, which are then put together by row."""
    df = text_column(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    every = blocks(stored(windows(benchmark, n), "windows"), max_mb)
    first = scan(df, next(every), text)
    hits = [stored(scan(df, rows).where("size(words) > 0").select("row", "words", "items"), "hits") for rows in every]
    if not hits:
        return first.drop("row")
    more = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.flatten(F.collect_list("words")).alias("more_words"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = lambda c: F.array_sort(F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(dict(more.dtypes)[f"more_{c}"]))))).alias(c)
    return first.join(more, "row", "left").select("doc_id", "n_words", both("words"), both("items"), *(["text"] if text else []))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_mb: int = MAX_MB) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated: a row per row of docs.

    A null or wordless text has no words and no hits; items without words have no window; an item of
    fewer than n words is one window. Items are sorted as strings and joined by commas for the digest
    (of the empty string if there are none). Items with a null key mark words but are not counted.
    Repeated rows stay repeated; other columns are not read; an empty benchmark hits nothing.
    """
    rows = scan_all(docs, benchmark, n, max_mb)
    return rows.select(
        "doc_id", "n_words", F.size("words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"),
    )


def spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_mb: int = MAX_MB) -> DataFrame:
    """doc_id, first, last, items: maximal runs of hit words as character offsets (half open) of the original text, for texts with hits."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t, hit, items in zip(*(c.to_pylist() for c in batch.columns)):
                at, own = [m.span() for m in WORD.finditer(t.translate(_LOWER))], set(hit)
                firsts, lasts = [w for w in hit if w - 1 not in own], [w for w in hit if w + 1 not in own]
                out += [(doc, at[i][0], at[j][1], items) for i, j in zip(firsts, lasts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["doc_id", "first", "last", "items"])

    hits = scan_all(docs, benchmark, n, max_mb, True).where(F.size("words") > 0)
    return hits.select("doc_id", "text", "words", "items").mapInArrow(go, "doc_id long, first long, last long, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_mb: int = MAX_MB) -> DataFrame:
    """The rows of docs, with all their columns, that no window of the benchmark occurs in; null texts stay. Of several blocks each goes over what the one before left."""

    def without(rows):
        shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = _tree(name, shared)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not occurrences(tree, t.as_py() or "")[1] for t in texts], pa.bool_()))

        return go

    last = None
    for rows in blocks(stored(windows(benchmark, n), "windows"), max_mb):
        if last is not None:
            docs = stored(docs.mapInArrow(without(last), docs.schema), "clean")
        last = rows
    return docs.mapInArrow(without(last), docs.schema)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The query op2_decontaminate in DuckDB; a row number stands for a document, as ids may repeat.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS v, item_id FROM s),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
h AS (SELECT r, i, x.n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM p) q JOIN x USING (n, v)),
m AS (SELECT r, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (r)
"""

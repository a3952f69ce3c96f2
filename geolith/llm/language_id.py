"""Language ID (7) by nearest centroids.

A text's vector counts its byte n-grams (2 and 3 bytes of lower-cased text, all but letters as
spaces) in DIMS hashed places, damped, weighted by inverse document frequency and of length one.
Each language has a few centroids, the means of clusters of its sample. A text gets the language of
the centroid with the largest cosine and is rejected if that is farther than nearly all texts of its
language and length are from theirs, by a margin. Frequencies and distances are taken over all rows
that fitting may look at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import give_back, stored, texts_of
from geolith.llm.words import pieces

DIMS = 4096
#: Bytes of a long text that are looked at together.
WINDOW = 1 << 20
#: Bytes and texts that are counted together; each text takes DIMS numbers.
PART = (1 << 17, 128)
#: Documents of a language that are looked at for fitting, at most about; and its clusters, at most.
SAMPLE, CLUSTERS = 800, 4
#: A cluster with a smaller share of its language's sample is left out: it is of texts in another language or of none.
SHARE = 0.02
#: A text is rejected if its cosine is under MARGIN times the quantile LOW of the rightly labelled training texts of its language and length class.
MARGIN, LOW = 0.8, 0.005
#: A class with fewer training texts takes the level of the nearest shorter one, else of the nearest longer one, times SHORTER for each class between.
ENOUGH, SHORTER = 20, 0.6
#: Length classes, and bins of cosines from 0 to 1 that are counted for the quantile.
CLASSES, BINS = 13, 200
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_LETTER = re.compile("[A-Za-z]")
_TABLE = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def _grams(data: np.ndarray, text: np.ndarray, out: np.ndarray, since: int = 0) -> None:
    """Add the n-grams of data (mapped bytes, with the text of each) that end at byte `since` or later to out (texts * DIMS)."""
    for n in (2, 3):
        if len(data) < n:
            continue
        skip = max(0, since - n + 1)
        code = data[skip : len(data) - n + 1].copy()
        for k in range(1, n):
            code = code << np.uint32(8) | data[skip + k : len(data) - n + 1 + k]
        place = (code * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(20)
        own = text[skip : len(text) - n + 1]
        inside = own == text[skip + n - 1 :]
        out += np.bincount(own[inside] * DIMS + place[inside], minlength=len(out))


def counts(column: pa.Array) -> np.ndarray:
    """(texts, DIMS): counts of hashed n-grams, whole texts between spaces; runs of spaces count as one. A long text goes in windows."""
    raw = [b" " + (x.as_py() or "").encode("utf-8", "surrogatepass") + b" " for x in column]
    out = np.zeros(len(raw) * DIMS, np.int64)
    if len(raw) == 1 and len(raw[0]) > WINDOW:
        before = np.zeros(0, np.uint32)  # the last two bytes that were kept
        for i in range(0, len(raw[0]), WINDOW):
            data = _TABLE[np.frombuffer(raw[0], np.uint8, min(WINDOW, len(raw[0]) - i), i)].astype(np.uint32)
            last = before[-1] if len(before) else 0
            data = data[(data != 32) | (np.concatenate([[last], data[:-1]]) != 32)]
            data = np.concatenate([before, data])
            _grams(data, np.zeros(len(data), np.int64), out, len(before))
            before = data[-2:]
        return out.reshape(1, DIMS).astype(np.float32)
    data = _TABLE[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    text = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    keep = np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32) | (text[1:] != text[:-1])])[: len(data)]
    _grams(data[keep], text[keep], out)
    return out.reshape(len(raw), DIMS).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def length_class(tf: np.ndarray) -> np.ndarray:
    """The power of two of the number of distinct n-grams, from 0 to 12: repeating a text tells no more of its language."""
    return np.log2(np.maximum((tf > 0).sum(axis=1), 1)).astype(int)


def _quantiles(seen: np.ndarray, enough: int) -> np.ndarray | None:
    """The level of each length class from counts (CLASSES, BINS) of cosines; None if no class has enough."""
    n = seen.sum(axis=1)
    full = np.flatnonzero(n >= enough)
    if not len(full):
        return None
    own = (seen.cumsum(axis=1) > LOW * n[:, None]).argmax(axis=1) / BINS
    return np.array([own[full[full <= s][-1]] if (full <= s).any() else own[full[0]] * SHORTER ** (full[0] - s) for s in range(CLASSES)])


def levels(seen: np.ndarray) -> np.ndarray:
    """(languages, CLASSES): the least cosine a text may have, from counts (languages, CLASSES, BINS); languages without enough texts take that of all."""
    whole = seen.sum(axis=0)
    spare = next((x for x in (_quantiles(whole, ENOUGH), _quantiles(whole, 1)) if x is not None), np.zeros(CLASSES))
    own = [_quantiles(x, ENOUGH) for x in seen]
    return MARGIN * np.array([spare if x is None else x for x in own]).reshape(-1, CLASSES)


def cluster(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most k clusters by cosine, from the first vector and then the farthest ones; the same for the same rows."""
    centres = [v[0]]
    while len(centres) < min(k, len(v)):
        near = (v @ np.array(centres).T).max(axis=1)
        centres.append(v[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    size = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
    return c[size >= max(1, SHARE * len(v))]


@dataclass
class Model:
    """Sorted languages' centroids: langs[i] and centroids[i], with the least cosine that a text of each length class may have."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each text and its cosine, from 0 to 1."""
        sims = vectors(tf, self.idf) @ self.centroids.T
        best = sims.argmax(axis=1)
        return best, np.clip(sims[np.arange(len(best)), best], 0, 1)

    def predict(self, column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        """Language (und without letters), cosine and rejection of each text; of equal cosines the first centroid's."""
        tf = counts(column)
        letters = [has_letter(x) for x in texts_of(column)]
        if not self.langs:
            return ["und"] * len(letters), [0.0] * len(letters), [True] * len(letters)
        best, score = self.nearest(tf)
        out = score < self.least[best, length_class(tf)]
        return [self.langs[b] if x else "und" for b, x in zip(best, letters)], [float(s) if x else 0.0 for s, x in zip(score, letters)], [bool(o) or not x for o, x in zip(out, letters)]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, train: Column) -> DataFrame:
    """id, lang, text of the rows that train marks and that have a language and a letter."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def sample(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """lang, text: of each language about `most` of the labelled rows at most, by a hash of the id."""
    sizes = rows.groupBy("lang").count()
    share = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes  # a row per language
    return rows.join(share, "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(most) / F.col("count") * (1 << 30)).select("lang", "text")


def frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the DIMS places over all rows. The driver gets the sums alone."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0), *PART):
                df[:DIMS] += (counts(part) > 0).sum(axis=0)
                df[DIMS] += len(part)
        if df[DIMS]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["place", "n"])
        give_back()

    df = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("text").mapInArrow(go, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r.place] = r.n
    return (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)


def cosines(rows: DataFrame, model: Model) -> np.ndarray:
    """(languages, CLASSES, BINS): how many of all rows have a cosine in a bin with the nearest centroid, if that is of their own language."""
    shared, names = rows.sparkSession.sparkContext.broadcast(model), sorted(set(model.langs))
    shape = (len(names), CLASSES, BINS)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, seen = shared.value, {x: i for i, x in enumerate(names)}, np.zeros(math.prod(shape), np.int64)
        of = np.array([at[x] for x in own.langs])
        for batch in batches:
            for start, part in pieces(batch.column(1), *PART):
                lang = np.array([at.get(x, -1) for x in batch.column(0).slice(start, len(part)).to_pylist()])
                tf = counts(part)
                best, score = own.nearest(tf)
                right = of[best] == lang
                place = np.ravel_multi_index((lang[right], length_class(tf)[right], np.minimum((score[right] * BINS).astype(int), BINS - 1)), shape)
                np.add.at(seen, place, 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["place", "n"])
        give_back()

    seen = np.zeros(math.prod(shape), np.int64)
    for r in rows.select("lang", "text").mapInArrow(go, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r.place] = r.n
    return seen.reshape(shape)


def fit(docs: DataFrame, train: Column | None = None, most: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """A model from text and non-null lang of docs' rows that train marks (all, if None).

    Document frequencies and the least cosines come from all those rows. Centroids come from a
    bounded sample (`most` a language, in expectation); its vectors, not its texts, are grouped by
    language. The driver gets sums and centroids only, `clusters` of DIMS numbers a language.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(1), *PART):
                tf = counts(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array([x.tobytes() for x in tf], pa.binary())], ["lang", "tf"])

    def centroids(table: pa.Table) -> pa.Table:
        rows = sorted(table.column("tf").to_pylist())
        c = cluster(vectors(np.array([np.frombuffer(x, np.float32) for x in rows]), idf), clusters)
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "centroid": [x.astype(np.float32).tobytes() for x in c]}, schema=pa.schema([("lang", pa.string()), ("centroid", pa.binary())]))

    rows = labelled(docs, F.lit(True) if train is None else train)
    idf = frequencies(rows)
    some = stored(sample(rows, most).mapInArrow(features, "lang string, tf binary"), "features")
    found = sorted(some.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary").collect())
    langs = [r.lang for r in found]
    model = Model(idf, langs, np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(-1, DIMS), np.zeros((len(langs), CLASSES)))
    if langs:
        names = sorted(set(langs))
        model.least = levels(cosines(rows, model))[[names.index(x) for x in langs]]
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (of the fold that fitting leaves out), lang_pred, score (cosine, 0 to 1), rejected: a row per row of docs.

    A null text, or one without a letter, is und with score 0 and rejected; so is every text if the
    model has no language. Only the text is looked at, whole. A null doc_id is not held out. Repeated rows
    repeat; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(2), *PART):
                lang, score, out = shared.value.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(go, RESULT)


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in pieces(batch.column(batch.schema.get_field_index("text")).cast(pa.string()), *PART):
                yield batch.slice(start, len(part)).filter(pa.array([not x for x in shared.value.predict(part)[2]], pa.bool_()))
        give_back()

    return docs.mapInArrow(go, docs.schema)


def learnable(doc_id: Column) -> Column:
    """Whether fitting may look at a document: its fold is not 2."""
    return F.coalesce(fold(doc_id) != 2, F.lit(False))

"""Text to mentions: tokens with offsets, tagging, parents in the text, context vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith import schemas

#: Labels of mentions to resolve, and of context; EVENT_LOC comes from taggers that mark events' places.
MENTION_LABELS = ("GPE", "LOC", "EVENT_LOC", "FAC")
CONTEXT_LABELS = ("GPE", "LOC", "EVENT_LOC", "NORP")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’]\p{L}+)?|[^\s\p{L}\p{N}]")
_LETTERS = regex.compile(r"\p{L}+")
_END = frozenset(".!?")

#: (text, start, end, sentence) of each token.
Tokens = list[tuple[str, int, int, int]]
#: (first token, token after the last, label) of each entity, in order, without overlaps.
Spans = list[tuple[int, int, str]]
Tagger = Callable[[Tokens], Spans]


def tokenise(text: str) -> Tokens:
    """Words and single marks with offsets; a sentence ends with . ! or ?"""
    out, sentence = [], 0
    for m in _WORD.finditer(text):
        out.append((m[0], m.start(), m.end(), sentence))
        sentence += m[0] in _END
    return out


class DictionaryTagger:
    """Marks the longest runs of words that are names, from left to right; a run starts with a capital letter."""

    def __init__(self, names: dict[str, str] | list[str]):
        names = names if isinstance(names, dict) else dict.fromkeys(names, "GPE")
        self.runs: dict[str, dict[tuple[str, ...], str]] = {}
        self.longest = 0
        for name, label in names.items():
            words = tuple(t[0].lower() for t in tokenise(name))
            if words:
                self.runs.setdefault(words[0], {})[words] = label
                self.longest = max(self.longest, len(words))

    def __call__(self, tokens: Tokens) -> Spans:
        out, i = [], 0
        while i < len(tokens):
            own = self.runs.get(tokens[i][0].lower()) if tokens[i][0][0].isupper() else None
            for n in range(min(self.longest, len(tokens) - i), 0, -1) if own else ():
                label = own.get(tuple(t[0].lower() for t in tokens[i : i + n]))
                if label:
                    out.append((i, i + n, label))
                    i += n - 1
                    break
            i += 1
        return out


def guess_in_rel(text: str, tokens: Tokens, spans: Spans, k: int, strict: bool = False) -> str:
    """The text of the entity that entity k is said to be in ("X in Y", "X, Y"), or an empty string.

    strict gives no parent where the next entity ends the document, as nothing follows that could tell a list.
    """
    last = spans[k][1]
    after = next((s for s in spans[k + 1 :] if s[0] > last), None)
    if after is None or after[2] not in MENTION_LABELS or tokens[after[0]][3] != tokens[spans[k][0]][3]:
        return ""
    gap = [t[0] for t in tokens[last : after[0]]]
    name = text[tokens[after[0]][1] : tokens[after[1] - 1][2]]
    if len(gap) <= 2 and "in" in gap and "and" not in gap:
        return name
    if "," not in gap or "and" in gap:
        return ""
    if after[1] >= len(tokens):
        return "" if strict else name
    return "" if tokens[after[1]][0] in (",", "and") else name


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out to all cores if the optimizer takes them for so small that a scan has fewer partitions; a large input is left as it lies."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * (4 << 20) else docs


class LoadedTagger:
    """A tagger that each worker loads once, by `load`, such as a language model; only `load` itself is sent."""

    _made: dict[str, Tagger] = {}

    def __init__(self, load: Callable[[], Tagger]):
        self.load, self.name = load, uuid.uuid4().hex

    def __call__(self, tokens: Tokens) -> Spans:
        if self.name not in self._made:
            self._made[self.name] = self.load()
        return self._made[self.name](tokens)


def check_tagger(tagger: Tagger | None) -> None:
    """Raise on the driver, before any job runs, if the tagger is not there, can't be loaded or does not mark spans."""
    if tagger is None:
        raise ValueError("a tagger is needed to find mentions in texts")
    try:
        spans = tagger(tokenise("Berlin is a city."))
        wrong = [x for x in spans if len(x) != 3 or not 0 <= x[0] < x[1] <= 5]
    except Exception as e:
        raise ValueError(f"the tagger can't be used: {e}") from e
    if wrong:
        raise ValueError(f"the tagger gives spans outside of the text: {wrong}")


def extract_mentions(docs: DataFrame, tagger: Tagger, strict: bool = False, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """MENTION rows of docs (doc_id, text), or with another key column: one pass, without a shuffle but for inputs of very few partitions. Texts that repeat may be tagged once with once_per_text."""
    schema = schemas.MENTION.replace("doc_id long", f"{key} {kind}")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf[key], pdf["text"]):
                tokens = tokenise(text or "")
                spans, n = tagger(tokens), 0
                for k, (i, j, label) in enumerate(spans):
                    if label in MENTION_LABELS:
                        rows.append((doc, n, text[tokens[i][1] : tokens[j - 1][2]], tokens[i][1], tokens[j - 1][2], label, tokens[i][3], guess_in_rel(text, tokens, spans, k, strict)))
                        n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(docs.select(F.col(key).cast(kind), F.col("text").cast("string"))).mapInPandas(go, schema)


def mentions_of_tokens(docs: DataFrame, strict: bool = False) -> DataFrame:
    """MENTION rows of documents that come parsed: doc_id, tokens (an array of TOKEN); neighbours with one label are an entity."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, own in zip(pdf["doc_id"], pdf["tokens"]):
                own = list(own) if own is not None else []
                tokens = [(t["text"], t["start"], t["end"], t["sentence"]) for t in own]
                text = [" "] * max((t[2] for t in tokens), default=0)
                for t in tokens:
                    text[t[1] : t[2]] = t[0]
                spans, i = [], 0
                while i < len(own):
                    j = i + 1
                    while j < len(own) and own[j]["label"] == own[i]["label"] and own[i]["label"]:
                        j += 1
                    if own[i]["label"]:
                        spans.append((i, j, own[i]["label"]))
                    i = j
                full, n = "".join(text), 0
                for k, (i, j, label) in enumerate(spans):
                    if label in MENTION_LABELS:
                        rows.append((doc, n, full[tokens[i][1] : tokens[j - 1][2]], tokens[i][1], tokens[j - 1][2], label, tokens[i][3], guess_in_rel(full, tokens, spans, k, strict)))
                        n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.MENTION.split(", ")])

    return docs.select("doc_id", "tokens").mapInPandas(go, schemas.MENTION)


def once_per_text(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], keep: bool = False) -> DataFrame:
    """stage on each distinct text once, its rows given to all documents of that text.

    stage: (text_key, text) -> rows with text_key, which stays if `keep`. Documents are rows of different doc_id or text: an id that repeats with
    another text gets both texts' rows, an exact repeat counts once, null ids are ids like others. A null text is an empty one.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.sha2("text", 256))
    once = keyed.groupBy("text_key").agg(F.first("text").alias("text"))  # in part before it is moved: a text that a third of all documents share is one row a task
    rows = stage(once).join(keyed.select("doc_id", "text_key").distinct(), "text_key")
    return rows if keep else rows.drop("text_key")


def pieces(docs: DataFrame, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """doc_id (or another key), pos, piece, start: runs of letters, with their places and character offsets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [list(_LETTERS.finditer(text or "")) for text in part.column(1).to_pylist()]
                n = np.array([len(x) for x in found], np.int64)
                flat = [m for x in found for m in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)),
                        pa.array([m[0] for m in flat], pa.string()), pa.array([m.start() for m in flat], pa.int64()),
                    ],
                    [key, "pos", "piece", "start"],
                )

    return spread(docs.select(F.col(key).cast(kind).alias(key), F.col("text").cast("string").alias("text"))).mapInArrow(go, f"{key} {kind}, pos long, piece string, start long")


def token_vectors(word_pieces: DataFrame) -> DataFrame:
    """doc_id, token, vec: each token's mean of its word pieces' vectors (doc_id, token, vec); zeros for a token without any (a null vec)."""

    each = word_pieces.select("doc_id", "token", F.posexplode_outer("vec").alias("i", "x"))
    means = each.groupBy("doc_id", "token", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))  # summed up in part before it is moved
    own = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "m"))))
    return means.groupBy("doc_id", "token").agg(F.transform(own, lambda x: x.m).alias("vec"))


def context_vectors(tokens: DataFrame, mentions: DataFrame, dims: int) -> DataFrame:
    """doc_id, mention_id, tensor, doc_tensor, locs_tensor.

    tokens: doc_id, token, label, vec; mentions: doc_id, mention_id, first, last (token numbers, half
    open). tensor is the mean over the mention's tokens, doc_tensor over all, locs_tensor over tokens
    with a context label outside of the mention (zeros without any). A document's tokens are one group.
    """

    def go(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("token")
        vecs = np.array(own["vec"].tolist(), np.float64).reshape(-1, dims) if len(own) else np.zeros((0, dims))
        number, context = own["token"].to_numpy(), own["label"].isin(CONTEXT_LABELS).to_numpy()
        mean = lambda mask: vecs[mask].mean(axis=0).tolist() if mask.any() else [0.0] * dims
        rows = []
        for m, i, j in zip(found["mention_id"], found["first"], found["last"]):
            inside = (number >= i) & (number < j)
            rows.append((key[0], m, mean(inside), mean(np.ones(len(vecs), bool)), mean(context & ~inside)))
        return pd.DataFrame(rows, columns=["doc_id", "mention_id", "tensor", "doc_tensor", "locs_tensor"])

    return tokens.groupBy("doc_id").cogroup(mentions.groupBy("doc_id")).applyInPandas(go, "doc_id long, mention_id int, tensor array<double>, doc_tensor array<double>, locs_tensor array<double>")


def event_location_text(mentions: DataFrame) -> DataFrame:
    """doc_id, event_location_raw: the texts that the tagger marked as events' places, in order, joined by spaces."""
    rows = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("label") == "EVENT_LOC", F.struct("start_char", "search_name")))).alias("own"))
    return rows.select("doc_id", F.array_join("own.search_name", " ").alias("event_location_raw"))

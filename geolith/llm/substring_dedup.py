"""Substring dedup (4) with difference-cover anchors.

COVER is a perfect difference cover modulo PERIOD: any two positions have a shift below PERIOD
that brings both onto cover positions. So two equal windows of WINDOW = PERIOD + ANCHOR - 1 words
share an anchor, ANCHOR words from a cover position of either document. Only anchors are hashed at
first; windows around anchors that occur in more than one document are then compared whole.

Documents are dealt into buckets. A bucket sends each other bucket ("dealer") the sorted distinct
hashes that fall to it and gets a bit for each in return; it computes the same list again when it
reads the bits. So a hash that any number of documents share is sent once by a bucket, no pairs
are made, and all that moves besides the texts is 8 bytes an anchor and 20 a candidate window. Buckets
are of a set size, so their number grows with the text; a bucket sends nothing to dealers for
which it has no hash, so there are never more messages than anchors, however many buckets there are.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import partitions, text_column
from geolith.llm.words import U, Words, pieces

#: Fixed: a perfect difference set modulo 31; every nonzero difference occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
WINDOW = 50
#: Text of a bucket, which one Python worker holds.
BUCKET_MB = 48
#: Stands for a null doc_id: it is behind all others.
LAST = np.iinfo(np.int64).max
MESSAGE = "dst int, src int, kind int, data binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<int>"


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return np.array([LAST if x is None else x for x in col.to_pylist()], np.int64)


def _cut(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where sorted hashes pass from one of n dealers to the next."""
    bounds = np.array([(k << 64) // n for k in range(1, n)], U)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])


class Bucket:
    """The texts of a bucket, in pieces, with their anchors; the same whenever it is built from the same rows."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.anchor = window, window - PERIOD + 1
        self.ids = _ids(table.column("doc_id"))
        self.parts, start = [], 0
        for chunk in table.column("text").chunks:  # never put together: an Arrow string array ends at 2 GiB
            self.parts += [(start + i, part) for i, part in pieces(chunk, 1 << 20, 4096)]
            start += len(chunk)
        self.anchors = []  # per piece: positions and hashes
        for _, w in self.pieces():
            place = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)
            at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (w.left() >= self.anchor) & (np.repeat(w.counts, w.counts) >= window))
            self.anchors.append((at, w.runs(at, self.anchor) & ~U(1), w.text_of()[at]))

    def pieces(self):
        for start, part in self.parts:
            yield start, Words(part)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, sorted, and whether two different doc_ids here have them."""
        h = np.concatenate([x[1] for x in self.anchors] or [np.zeros(0, U)])
        ids = np.concatenate([self.ids[start + x[2]] for (start, _), x in zip(self.parts, self.anchors)] or [np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        both = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(h) else np.zeros(0, bool)
        return h[first], both

    def candidates(self, distinct: np.ndarray, shared: np.ndarray):
        """Per piece: its first row, its words, and the starts of windows around a shared anchor."""
        for (start, w), (at, h, text) in zip(self.pieces(), self.anchors):
            own = shared[np.searchsorted(distinct, h)] if len(h) else np.zeros(0, bool)
            at, text = at[own], text[own]
            low, high = np.maximum(at - (self.window - self.anchor), w.first[text]), np.minimum(at, w.first[text + 1] - self.window)
            step = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(step, low[low <= high], 1)
            np.add.at(step, high[low <= high] + 1, -1)
            yield start, w, np.flatnonzero(np.cumsum(step) > 0)

    def windows(self, distinct: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidate windows: two hashes and doc_id, in order of the texts."""
        out = [(w.runs(p, self.window), w.runs2(p, self.window), self.ids[start + w.text_of()[p]]) for start, w, p in self.candidates(distinct, shared)]
        return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, kind)]) for k, kind in enumerate((U, np.uint32, np.int64)))


def _groups(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both hashes, each row's group in that order, and the groups' least ids."""
    order = np.lexsort((g, h))
    a, b = h[order], g[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(a) else np.zeros(0, np.int64)
    return order, np.cumsum(new) - 1, least


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["dst", "src", "kind", "data"])


def _bits(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {d: x for d, k, x in zip(*(table.column(c).to_pylist() for c in ("dst", "kind", "data"))) if k == kind}


def _unpack(bits: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    """The bits of all dealers as one mask; cuts say how many each has."""
    out = np.zeros(int(cuts[-1]), bool)
    for d, x in bits.items():
        i, j = cuts[d], cuts[d + 1]
        out[i:j] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(j - i)).view(bool)
    return out


def bucket_number(docs: DataFrame) -> int:
    """Buckets of about BUCKET_MB of text, at least two for each shuffle partition. A document that is longer makes its bucket as long."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(2 * partitions(docs.sparkSession), -(-size // (BUCKET_MB << 20)))


def dedup(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), removed (first word and
    the word after the last, of each removed run): a row per row of docs.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
    A word goes if a window of `window` words that covers it starts also in a row with a smaller
    doc_id; rows with equal doc_id do not remove each other's words, a null doc_id is behind all
    others. A null text has no words; texts of fewer words than a window keep all. Texts are never cut. Other
    columns are not read; an empty table gives none. A window takes at least PERIOD words.
    """
    if window < PERIOD:
        raise ValueError(f"a window takes at least {PERIOD} words")
    n = buckets or bucket_number(docs)

    def send(table: pa.Table) -> pa.Table:
        src = table.column("bucket")[0].as_py()
        h, both = Bucket(table, window).hashes()
        cuts, h = _cut(h, n), h | both.astype(U)
        return _messages([(d, src, 1, h[i:j].tobytes()) for d, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j])

    def shared(table: pa.Table) -> pa.Table:
        dst, each = table.column("dst")[0].as_py(), [np.frombuffer(x, U) for x in table.column("data").to_pylist()]
        every = np.concatenate(each)
        h = every & ~U(1)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = np.concatenate([h[1:] == h[:-1], [False]])
        same[1:] |= same[:-1]
        out = np.empty(len(h), bool)
        out[order] = same
        out |= (every & U(1)).astype(bool)
        ends = np.cumsum([len(x) for x in each])
        return _messages([(dst, s, 1, np.packbits(out[e - len(x) : e]).tobytes()) for s, x, e in zip(table.column("src").to_pylist(), each, ends)])

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        src, bucket = table.column("bucket")[0].as_py(), Bucket(table, window)
        distinct, _ = bucket.hashes()
        mask = _unpack(_bits(replies, 1), _cut(distinct, n))
        h, g, ids = bucket.windows(distinct, mask)
        order, group, least = _groups(h, g, ids)
        first = order[np.searchsorted(group, np.arange(len(least)))]
        h, g, cuts = h[first], g[first], _cut(h[first], n)
        rows = [(d, src, 2, b"".join(x[i:j].tobytes() for x in (h, least, g))) for d, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        return _messages([*rows, (src, src, 1, np.packbits(mask).tobytes())])

    def least_of(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("dst", "src", "kind", "data"))))
        mine = [r for r in rows if r[2] == 2]
        sizes = [len(r[3]) // 20 for r in mine]
        part = lambda kind, at, size: np.concatenate([np.frombuffer(r[3], kind, k, at * k) for r, k in zip(mine, sizes)] or [np.zeros(0, kind)])
        h, ids, g = part(U, 0, 8), part(np.int64, 8, 8), part(np.uint32, 16, 4)
        order, group, least = _groups(h, g, ids)
        out = np.empty(len(h), bool)
        out[order] = least[group] < ids[order]
        ends = np.cumsum(sizes)
        return _messages([*((d, s, 2, np.packbits(out[e - k : e]).tobytes()) for (d, s, *_), k, e in zip(mine, sizes, ends)), *(r for r in rows if r[2] == 1)])

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            bucket = Bucket(table, window)
            distinct, _ = bucket.hashes()
            masks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(distinct)).view(bool) for x in _bits(replies, 1).values()]
            mask = masks[0] if masks else np.zeros(len(distinct), bool)
            h, g, ids = bucket.windows(distinct, mask)
            order, group, least = _groups(h, g, ids)
            heads = h[order[np.searchsorted(group, np.arange(len(least)))]]
            elsewhere = _unpack(_bits(replies, 2), _cut(heads, n))
            gone = np.empty(len(h), bool)
            gone[order] = elsewhere[group] | (least[group] < ids[order])
            k = 0
            for start, w, p in bucket.candidates(distinct, mask):
                p, k = p[gone[k : k + len(p)]], k + len(p)
                step = np.zeros(len(w.starts) + 1, np.int64)
                step[p] += 1
                step[p + window] -= 1
                keep = np.cumsum(step[:-1]) == 0
                for i in range(len(w.counts)):
                    own, words = keep[w.first[i] : w.first[i + 1]], w.split(i)
                    n_removed = len(own) - int(np.count_nonzero(own))
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8))) if n_removed else ()
                    rows.append((int(bucket.ids[start + i]), len(words), n_removed, b" ".join(compress(words, own) if n_removed else words), edges))
        return pa.table(
            [
                pa.array([None if r[0] == LAST else r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[4] for r in rows], pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_words", "n_removed", "kept", "removed"],
        )

    rows = text_column(docs, "doc_id", "text").withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    by_bucket = rows.groupBy("bucket")  # the same exchange for all three passes
    anchors = by_bucket.applyInArrow(send, MESSAGE).groupBy("dst").applyInArrow(shared, MESSAGE)
    again = by_bucket.cogroup(anchors.groupBy("src")).applyInArrow(send_windows, MESSAGE)
    answers = again.groupBy("dst").applyInArrow(least_of, MESSAGE)
    return by_bucket.cogroup(answers.groupBy("src")).applyInArrow(cut, RESULT)


#: The query op4_substring_dedup in DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM s),
c AS (SELECT doc_id, list_sort(list(i)) AS starts FROM m WHERE least < doc_id GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n, words, list_distinct(flatten([range(x, x + 50) for x in coalesce(starts, [])])) AS gone FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN len(gone) = 0 THEN array_to_string(words, ' ') ELSE array_to_string([x for x, j in words if not list_contains(gone, j)], ' ') END, '')) AS kept_sha256
FROM k
"""

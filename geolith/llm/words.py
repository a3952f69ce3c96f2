"""Words of whole texts as numpy arrays: spans, 64-bit hashes, and hashes of runs of words.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed; that of a word
over LONG bytes, where such polynomials have systematic collisions, is cryptographic. A run's hash is a
polynomial over its words' hashes. Texts of an Arrow column go together, bytes and words in blocks, so
what is held beside the text is some 30 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * base**i."""
        if len(values) >= len(self.up):
            n = len(values) + len(values) // 4 + 1
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (self.base, self.inverse))
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of values[first:last], wherever it stands."""
        return (sums[last] - sums[first]) * self.down[first]


_BYTES, _WORDS, _WORDS2 = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
#: Bytes, and words, that are hashed at a time; and the length from which a word is hashed by itself.
BYTES, RUNS, LONG = 1 << 20, 1 << 18, 256


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _blocks(places: np.ndarray, size: int):
    """Index ranges of ascending places, each over at most about size places."""
    if len(places):
        cuts = np.searchsorted(places, np.arange(int(places[0]) + size, int(places[-1]) + 1, size))
        edges = np.unique(np.concatenate([[0], cuts, [len(places)]])).tolist()
        yield from zip(edges[:-1], edges[1:])


class Words:
    """The words of some texts: spans in bytes, first[i]:first[i + 1] the words of text i, hash of each word."""

    def __init__(self, column: pa.Array, lower: bool = False):
        col = pc.fill_null(column, "").cast(pa.large_binary())
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.data, self.at = data, at - at[0]
        edge = np.unique(self.at)  # no word goes over the end of a text
        starts, ends = [], []
        for i in range(0, len(data), BYTES):
            j = min(len(data), i + BYTES)
            word = ~WHITE[data[max(0, i - 1) : j + 1]]  # with a byte before and behind
            if i == 0:
                word = np.concatenate([[False], word])
            if j == len(data):
                word = np.concatenate([word, [False]])
            new = np.zeros(j - i + 1, bool)
            own = edge[np.searchsorted(edge, i) : np.searchsorted(edge, j, "right")] - i
            new[own] = True
            starts.append(np.flatnonzero(word[1:-1] & (~word[:-2] | new[:-1])) + i)
            ends.append(np.flatnonzero(word[1:-1] & (~word[2:] | new[1:])) + i + 1)
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.hash = np.empty(len(self.starts), U)
        long = np.flatnonzero(self.ends - self.starts > LONG)
        short = np.flatnonzero(self.ends - self.starts <= LONG) if len(long) else np.arange(len(self.starts))
        for i, j in _blocks(self.starts[short], BYTES):
            own = short[i:j]
            low, high = self.starts[own[0]], self.ends[own[-1]]
            part = data[low:high]
            sums = _BYTES.sums((_LOWER[part] if lower else part).astype(U) + U(1))
            self.hash[own] = mixed(_BYTES.between(sums, self.starts[own] - low, self.ends[own] - low))
        for i in long:
            part = data[self.starts[i] : self.ends[i]]
            self.hash[i] = int.from_bytes(hashlib.blake2b((_LOWER[part] if lower else part).tobytes(), digest_size=8).digest(), "little")

    def text_of(self) -> np.ndarray:
        """For each word its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """For each word the words from it to its text's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def _runs(self, powers: Powers, hashes: np.ndarray, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        out, last = np.empty(len(first), U), first + n
        for i, j in _blocks(first, RUNS):
            low, high = int(first[i]), int(last[i:j].max())
            out[i:j] = powers.between(powers.sums(hashes[low:high]), first[i:j] - low, last[i:j] - low)
        return mixed(out)

    def runs(self, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs of n words from first, which ascends."""
        return self._runs(_WORDS, self.hash, first, n)

    def runs2(self, first: np.ndarray, n: int) -> np.ndarray:
        """32 more bits, of other powers and other hashes of the words."""
        return (self._runs(_WORDS2, mixed(self.hash + U(0x632BE59BD9B4E019)), first, n) >> U(32)).astype(np.uint32)

    def split(self, i: int) -> list[bytes]:
        """The words of text i."""
        return self.data[self.at[i] : self.at[i + 1]].tobytes().split()


def pieces(column: pa.Array, limit: int = 1 << 18, rows: int = 512):
    """(first row, slice) of a column, cut at about limit bytes of text and at rows; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist(), 1):
        total += n
        if total >= limit or i - start == rows:
            yield start, column.slice(start, i - start)
            start, total = i, 0
    if start < len(sizes):
        yield start, column.slice(start)

"""Byte-pair encoding of whole texts through the tokenizers library, a pre-token at a time.

The pre-tokenizer cuts a text before any merge, so the ids of a text are those of its
pre-tokens in order. There is a cut before every space that follows another character, so
what lies between spaces can be looked up whole; such words repeat, and each distinct one is
merged by the library's model once, as long as it stays in the worker's cache. Python's classes
(letter, digit, white space, other) were proven equal to the library's for every character but those of the categories ODD
and the four separators in WHOLE. Words with odd ones go through the library, word by word; texts with a
separator, or with a special token's string, go through it whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed: the byte-level pre-tokenizer's pattern in the classes of the re module; equal to it on texts without odd characters.
PRETOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Categories whose characters the re module takes for letters and the library for numbers, or that newer tables than Python's may have filled.
ODD = frozenset(("No", "Nl", "Cn"))
#: White space for the re module alone.
WHOLE = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Words in each of a cache's two halves, and words whose values are kept in Arrow arrays.
CACHE, KNOWN = 50_000, 600_000
#: Bytes of text that are cut into words together; a longer text is alone.
PIECE = 8 << 20

_loaded: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one above U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class Kinds(dict):
    """Character -> whether it is odd."""

    def __missing__(self, c: str) -> bool:
        self[c] = unicodedata.category(c) in ODD
        return self[c]


class Spelt(dict):
    """Code point -> the byte-level letters of its UTF-8 bytes."""

    def __init__(self):
        self.letters = byte_letters()

    def __missing__(self, point: int) -> str:
        self[point] = "".join(self.letters[b] for b in chr(point).encode())
        return self[point]


class Cache(dict):
    """Word -> value of the pre-tokens of a space and the word. When full, it becomes the old half, which is asked before a value is made anew.

    Letters and what follows them are separate pre-tokens, so of a word only its leading letters are kept, and what follows in `ends`;
    a word with up to three more characters is kept itself if its letters were seen before.
    """

    def __init__(self, word: Callable, part: Callable, strange: Callable, kind: pa.DataType):
        self.word, self.part, self.strange, self.old, self.ends = word, part, strange, {}, {}
        self.words, self.values = pa.array([], pa.string()), pa.array([], kind)

    def __missing__(self, word: str):
        if word.isalpha():
            value = self.old.get(word)
            if value is None:
                value = self.word(word)
            self[word] = value
            return value
        if self.strange(word):
            value = self[word] = self.part(f" {word}")
            return value
        stem = LETTERS.match(word)
        if not stem:
            return self.part(f" {word}")
        at = stem.end()
        stem, end = word[:at], word[at:]
        tail = self.ends.get(end)
        if tail is None:
            if len(self.ends) > CACHE // 4:
                self.ends.clear()
            tail = self.ends[end] = self.part(end)
        if len(end) <= 3 and stem in self:
            value = self[word] = self[stem] + tail
            return value
        return self[stem] + tail

    def known(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Values of known words, and the place among them of each of the distinct words asked for; new ones are added. When there are too many, those asked for now stay."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        values = pa.array(list(map(self.__getitem__, new.to_pylist())), self.values.type)
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        self.words, self.values = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.values, values])
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        found = self.values
        if len(self.words) > KNOWN:
            self.words, self.values = words, found.take(pa.array(place))
        return found, place


class Encoder:
    """The library's tokenizer, with caches for ids (little-endian unsigned 32-bit) and for their number."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters, self.odd = Spelt(), Kinds()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.ids = Cache(self.word, self.merged, self.strange, pa.binary())
        self._counts: Cache | None = None

    def strange(self, part: str) -> bool:
        """Whether there is an odd character."""
        return not part.isascii() and any(map(self.odd.__getitem__, set(part)))

    def by_library(self, part: str) -> list[int]:
        return self.library.encode(part, add_special_tokens=False).ids

    def word(self, letters: str) -> bytes:
        """The ids of a space and letters."""
        return array("I", [t.id for t in self.model.tokenize("Ġ" + (letters if letters.isascii() else letters.translate(self.letters)))]).tobytes()

    def merged(self, part: str) -> bytes:
        """The ids of a part of a plain text by the library's model."""
        if self.strange(part):
            return packed(self.by_library(part))
        return packed([t.id for p in PRETOKEN.findall(part) for t in self.model.tokenize(p.translate(self.letters))])

    def whole_tokens(self) -> frozenset[str]:
        """The vocabulary's strings that are one pre-token and that the library encodes alone as one token."""
        n = self.library.get_vocab_size(with_added_tokens=False)
        words = [x for x in self.library.decode_batch([[i] for i in range(n)]) if x and not self.strange(x) and not WHOLE.search(x) and PRETOKEN.findall(x) == [x]]
        return frozenset(x for x, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)) if len(e.ids) == 1)

    def counter(self, whole: frozenset[str] | None = None) -> Cache:
        """Number of ids: one for each pre-token that is a whole token; only others are merged. The tokens are proven anew, if not given."""
        if self._counts is None:
            whole = self.whole_tokens() if whole is None else whole
            number = lambda part: len(self.by_library(part)) if self.strange(part) else sum(1 if p in whole else len(self.merged(p)) // 4 for p in PRETOKEN.findall(part))
            known = {x[1:] for x in whole if x[0] == " "}
            self._counts = Cache(lambda w: 1 if w in known else len(self.word(w)) // 4, number, self.strange, pa.int64())
        return self._counts

    def plain(self, text: str) -> bool:
        return not WHOLE.search(text) and not any(x in text for x in self.special)

    def pieces(self, text: str, cache: Cache) -> list:
        """The values of a plain text's parts, each from a cut to the next; those of one space and a word are looked up."""
        return [cache[x[1:]] if x[0] == " " and x[1:2] not in ("", " ") else cache.part(x) for x in _CUT.split(text) if x]

    def encode(self, text: str) -> bytes:
        """A text's ids."""
        return b"".join(self.pieces(text, self.ids)) if self.plain(text) else packed(self.by_library(text))

    def count(self, text: str) -> int:
        """A text's number of ids."""
        return sum(self.pieces(text, self.counter())) if self.plain(text) else len(self.by_library(text))

    def looked_up(self, column: pa.Array, cache: Cache, one: Callable) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Values, the index among them of each word of the column's texts, and where the texts begin.

        Arrow cuts the texts at spaces, finds the distinct words and looks them up among those known, so
        only new ones come to Python. Texts that are not plain, or with two spaces in a row, are one word, of the value one(text).
        """
        col = pc.fill_null(column, "")
        slow = pc.or_(pc.match_substring(col, "  "), pc.match_substring_regex(col, WHOLE.pattern))
        for x in self.special:
            slow = pc.or_(slow, pc.match_substring(col, x))
        parts = pc.split_pattern(pc.if_else(slow, "", col), " ")
        begins = parts.offsets.to_numpy()
        words = parts.values.dictionary_encode()
        values, place = cache.known(words.dictionary)
        index = place[words.indices.to_numpy()]
        first = [cache.part(x) for x in parts.values.take(pa.array(begins[:-1])).to_pylist()]  # no space before these
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)):
            first[i] = one(col[int(i)].as_py())
        index[begins[:-1]] = len(values) + np.arange(len(first))
        return pa.concat_arrays([values, pa.array(first, values.type)]), index, begins

    def encode_all(self, column: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """All ids of the column's texts, each followed by end, and their number in each text."""
        values, index, begins = self.looked_up(column, self.ids, self.encode)
        index = np.insert(index, begins[1:], len(values))
        begins = begins + np.arange(len(begins))
        ids = pa.concat_arrays([values, pa.array([end], values.type)]).take(pa.array(index))
        at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)
        return ids.buffers()[2] or pa.py_buffer(b""), np.diff(at[begins].astype(np.int64)) // 4

    def count_all(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not len(column):
            return np.zeros(0, np.int64)
        values, index, begins = self.looked_up(column, self.counter(), self.count)
        return np.add.reduceat(values.to_numpy()[index], begins[:-1])


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; the library must not start threads in it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]

"""Texts as sequences of chunks, and a bounded cache from chunk to token ids.

Some places always begin a new match of the byte-level split pattern, whatever stands around them: a space that a non-space follows, a
single line end and the character behind it, and one of ``.,;:!?`` behind a Latin letter. So a text may be cut there, each chunk may be
encoded alone, and the ids joined again. Words repeat, so most chunks come from the cache.

A chunk that begins with a space is written without it; any other one has ``GLUED`` in front.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GLUED = "\x01"
#: White space as in the patterns of tokenizers (Arrow's own is ASCII only), and texts that Arrow can't cut: several white spaces in a row, a space at the end, or the mark.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf" ({_SPACE}|\z)|\n{_SPACE}|{_SPACE}\n|\x01"
_ENDS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?])"


def split_words(text: str) -> list[str]:
    """Chunks of any text, cut at spaces only: those that a non-space follows."""
    words = text.split(" ")
    out = [GLUED + words[0]]
    for word in words[1:]:
        if word and not word[0].isspace() and word[0] != GLUED:
            out.append(word)
        else:
            out[-1] += " " + word
    return out


def split_texts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts one after the other, and how many each text has (one at least)."""
    if pc.any(pc.match_substring_regex(column, _ODD)).as_py():
        lists = [split_words(t) for t in column.to_pylist()]
        return pa.array([w for words in lists for w in words], pa.string()), np.fromiter(map(len, lists), np.int64, len(lists))
    marked = pc.replace_substring_regex(column, _ENDS, rf"\1 {GLUED}\2")
    marked = pc.binary_join_element_wise(GLUED, pc.replace_substring(marked, "\n", f" {GLUED}\n {GLUED}"), "")
    lists = pc.split_pattern(marked, " ")
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


class _Places(dict):
    """Place of each chunk; one not yet known gets the next place and waits in ``new``."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        place = self[key] = len(self)
        return place


class ChunkCache:
    """Ids of chunks in one flat array. ``encode`` gives the id lists of many chunks.

    The first ``most`` chunks stay, as the frequent ones come early; up to ``recent`` later ones are kept until that many have come.
    If the first ones stop being frequent, so that half of the words of a call are new, the cache starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 300_000, recent: int = 200_000):
        self.encode, self.most, self.recent = encode, most, recent
        self.clear()

    def clear(self) -> None:
        self.places = _Places()
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = self.base = 0
        self.later: list = []

    def _add(self, first: int) -> None:
        """Encode what waits; its places begin at ``first``."""
        lists = self.encode([k[1:] if k[:1] == GLUED else " " + k for k in self.places.new])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        last, total = first + len(lists), int(counts.sum())
        while len(self.starts) < last:
            self.starts, self.counts = np.concatenate([self.starts, self.starts]), np.concatenate([self.counts, self.counts])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, self.flat])
        self.counts[first:last] = counts
        self.starts[first:last] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        self.used += total

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null as empty) one after the other, and how many each text has."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, sizes = split_texts(column.fill_null(""))
        first = len(self.places)
        coded = keys.dictionary_encode()
        known = coded.dictionary.to_pylist()  # each different chunk is looked up once
        at = np.fromiter(map(self.places.__getitem__, known), np.int64, len(known))[np.asarray(coded.indices)]
        if self.places.new:
            self._add(first)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - counts), counts)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        if first >= self.most and 2 * len(self.places.new) > len(keys):
            self.clear()
        elif first >= self.most:
            self.later += self.places.new
            if len(self.later) > self.recent:
                for key in self.later:
                    del self.places[key]
                self.later, self.used = [], self.base
        else:
            self.base = self.used
        self.places.new = []
        return flat, np.diff(bounds)

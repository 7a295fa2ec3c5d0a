"""Words, word hashes and hashes of word shingles of texts, computed in batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .chunk_cache import _Places

#: Words are runs of letters, digits and underscores of the lower-cased text.
WORD = re.compile(r"\w+")
#: Fixed odd multiplier of the shingle hash.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHasher:
    """64-bit hashes of words, remembered up to `limit` words."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Places()
        self.table = np.zeros(1 << 12, np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self._clear()
        place = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            self.index.new = []
            n = len(self.index)
            if n > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(n, np.uint64)])
            self.table[n - len(new) : n] = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in new), np.uint64, len(new))
        return self.table[place]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words (of the whole text where it has fewer; none where it has no word), repeated ones included."""
    width = min(width, len(h))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _MULTIPLIER + h[i : i + n]
    return mix(out + np.uint64(width))

"""Encodes texts chunk by chunk with a bounded memory of chunks already encoded."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `chars` characters, to bound what is held at once."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def byte_slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, end - at
        at = end


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large cache that a Python worker keeps between tasks; that of another operator or model is dropped first."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Returns freed memory to the machine: a worker lives through many tasks, and what one of them needed at its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


class _Places(dict):
    """Chunk -> place; a chunk that is met for the first time gets the next place and is noted in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:start + size] of all, one after the other, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)], ends


class ChunkCache:
    """Results of chunks in one flat array. `encode_new` gets chunks that aren't known and gives their results, one after the other, and the number of results of each.

    At most `limit` chunks of `chars` characters in all are kept beyond the texts in hand;
    when there are more, the half that was met in the most slices of text stays.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000, chars: int = 12_000_000, dtype: Any = np.uint32):
        self.encode_new, self.limit, self.most_chars = encode_new, limit, chars
        self.index: dict[str, int] = {}
        self.start, self.size, self.length, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.flat = np.zeros(1 << 14, dtype)
        self.used = self.chars = 0

    @staticmethod
    def _grown(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        out = np.zeros(max(need, len(array) + len(array) // 2), array.dtype)
        out[: len(array)] = array
        return out

    def _add(self, new: list[str]) -> None:
        values, sizes = self.encode_new(new)
        n, total = len(self.index), len(values)
        self.start, self.size, self.length, self.uses = (self._grown(a, n) for a in (self.start, self.size, self.length, self.uses))
        self.flat = self._grown(self.flat, self.used + total)
        at = slice(n - len(new), n)
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.length[at] = np.fromiter(map(len, new), np.int64, len(new))
        self.uses[at] = 0
        self.flat[self.used : self.used + total] = values
        self.used += total
        self.chars += int(self.length[at].sum())

    def _shrink(self) -> None:
        n = len(self.index)
        order = np.argsort(-self.uses[:n], kind="stable")[: self.limit // 2]
        keep = np.sort(order[np.cumsum(self.length[order]) <= self.most_chars // 2])
        keys = list(self.index)
        self.index = {keys[i]: k for k, i in enumerate(keep.tolist())}
        flat, ends = gathered(self.flat, self.start[keep], self.size[keep])
        for name in ("size", "length", "uses"):
            old = getattr(self, name)
            new = np.zeros(max(1 << 12, len(keep)), np.int64)
            new[: len(keep)] = old[keep]
            setattr(self, name, new)
        self.uses >>= 1
        self.start = np.zeros(len(self.size), np.int64)
        self.start[: len(keep)] = ends - self.size[: len(keep)]
        self.flat = self._grown(flat, 1 << 14)
        self.used, self.chars = len(flat), int(self.length.sum())

    def places(self, chunks: list[str]) -> np.ndarray:
        """The place of each of these distinct chunks in the tables, after new ones have been encoded. Places hold until the next call."""
        if len(self.index) > self.limit or self.chars > self.most_chars:
            self._shrink()
        index = self.index
        out = np.fromiter(map(index.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(at := np.flatnonzero(out < 0)):
            new = [chunks[i] for i in at.tolist()]
            out[at] = np.arange(len(index), len(index) + len(new))
            index.update(zip(new, out[at].tolist(), strict=True))
            self._add(new)
        self.uses[out] += 1
        return out

    def looked_up(self, chunks: pa.Array) -> np.ndarray:
        """The place of each chunk, repeated ones included."""
        coded = chunks.dictionary_encode()
        return self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Results of all texts, one after the other, and the number of results of each; parts: the chunks of each text."""
        place = self.looked_up(parts.flatten())
        values, ends = gathered(self.flat, self.start[place], self.size[place])
        return values, np.diff(np.concatenate([[0], ends])[list_edges(parts)])


def list_edges(parts: pa.ListArray) -> np.ndarray:
    """Where each list begins among the flattened values, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)

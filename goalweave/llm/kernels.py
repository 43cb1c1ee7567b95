"""Small numpy helpers that run in Python workers; they travel with the job."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits (multiply and shift, a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def as_bytes(text: str | None) -> bytes:
    """UTF-8; a lone surrogate cannot occur in Spark's strings."""
    return b"" if text is None else text.encode()


def kept(name: str, make):
    """What ``make`` gives, made once per Python worker and kept for its later tasks."""
    shelf = sys.__dict__.setdefault("_goalweave_kept", {})
    if name not in shelf:
        shelf[name] = make()
    return shelf[name]


class WordTable:
    """Ids of words in one flat array, looked up for many words at once."""

    def __init__(self):
        self.code: dict = {}
        self.store = np.empty(0, np.int64)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.code)

    def unknown(self, words: list) -> list:
        return [w for w in dict.fromkeys(words) if w not in self.code]

    def add(self, words: list, ids: np.ndarray, length: np.ndarray) -> None:
        """Words with all their ids in one array, and how many each has."""
        start = len(self.store) + np.cumsum(length) - length
        self.code.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.store = np.concatenate([self.store, ids])
        self.start, self.length = np.append(self.start, start), np.append(self.length, length)

    def only(self, words: list) -> "WordTable":
        """A table of these words alone."""
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        fresh = WordTable()
        fresh.add(words, self.of(code), self.length[code])
        return fresh

    def of(self, code: np.ndarray) -> np.ndarray:
        """The ids of the words with these codes, one word after another."""
        length = self.length[code]
        ends = np.cumsum(length)
        return self.store[np.repeat(self.start[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]

    def joined(self, words: list, counts: list[int]):
        """Yield the ids of the first counts[0] words, then of the next counts[1], and so on."""
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        ids = self.of(code)
        cuts = np.concatenate([[0], np.cumsum(self.length[code])])[np.cumsum([0, *counts])]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b]


def small(batches, rows: int = 500, keep: str | None = None):
    """The same rows in small batches, so that what a worker makes of one stays small.

    What earlier operators have kept in this worker goes first, but for ``keep``; memory not in use is given back at the end.
    """
    shelf = sys.__dict__.get("_goalweave_kept", {})
    for name in [n for n in shelf if n != keep]:
        del shelf[name]
    for batch in batches:
        for i in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()

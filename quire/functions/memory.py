"""A worker's memory of words already encoded."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa


def give_back():
    """Hand memory that was freed back to the system: Spark's workers live on and run other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


#: What a remembered word takes besides its letters and ids: string and dictionary entry.
WORD_BYTES = 150


class WordMemory:
    """Encodes lists of words, each distinct word once while it is remembered.

    ``encode`` turns a list of new words into (all ids, ids per word).  Beyond
    ``most`` bytes, about, the memory starts anew, so its size is bounded; ``forget`` frees it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 160 << 20):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self):
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)        # word k has ids flat[at[k]:at[k + 1]]
        self.used = 0

    def _learn(self, new: list[str]):
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            ids, sizes = self.encode(part)
            n = len(self.number)
            while len(self.at) <= n + len(part):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            while len(self.flat) < self.used + len(ids):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.at[n + 1:n + 1 + len(part)] = self.used + np.cumsum(sizes)
            self.used += len(ids)
            self.number.update(zip(part, range(n, n + len(part))))
            self.bytes += sum(map(len, part)) + 4 * len(ids) + WORD_BYTES * len(part)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, running ends per word with a leading 0)."""
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(numbers < 0)
        if len(miss):
            new = list(dict.fromkeys(words[i] for i in miss))
            if self.number and self.bytes + WORD_BYTES * len(new) > self.most:
                self.forget()
                new, miss = list(dict.fromkeys(words)), range(len(words))
            self._learn(new)
            for i in miss:
                numbers[i] = self.number[words[i]]
        lo = self.at[numbers]
        size = self.at[numbers + 1] - lo
        end = np.cumsum(size)
        ids = self.flat[np.repeat(lo - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])

"""A sorted set of offsets in the manner of a Roaring bitmap.

Values are grouped by their high bits into containers of 65,536 values.  A container is the
smallest of three kinds: a sorted array of the low 16 bits, a bitmap of 65,536 bits with running
counts per word, or runs of consecutive values.  The cumulative cardinalities of the containers
answer "the k-th value" by a search for its container and a selection inside it.
"""

from __future__ import annotations

import numpy as np

LOW = 16
WORDS = (1 << LOW) // 64


class Array:
    """Low bits, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)
        self.nbytes = self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """One bit a value; the counts of the words before each word find the word that holds the k-th value."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.zeros(WORDS, np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.nbytes = self.words.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k - int(self.before[word])])


class Runs:
    """First value of each run and the number of values before it."""

    def __init__(self, low: np.ndarray):
        begins = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
        self.first, self.before = low[begins].astype(np.uint16), begins.astype(np.int32)
        self.nbytes = self.first.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of the sorted distinct ``low`` bits."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    sizes = [(2 * len(low), Array), (12 * WORDS, Bitmap), (6 * runs, Runs)]
    return min(sizes, key=lambda s: s[0])[1](low)


class BoundarySet:
    """Sorted distinct values >= 0; ``len`` is their number and ``select(k)`` the k-th, from 0."""

    def __init__(self, values: np.ndarray):
        high = values >> LOW
        edge = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(values, edge) if len(values) else []
        self.high = [int(p[0]) >> LOW for p in parts]
        self.containers = [container(p & ((1 << LOW) - 1)) for p in parts]
        self.cumulative = np.cumsum([len(p) for p in parts], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.cumulative, k, "right"))
        local = k - (int(self.cumulative[at - 1]) if at else 0)
        return (self.high[at] << LOW) + self.containers[at].select(local)

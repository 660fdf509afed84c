"""Helpers shared by the training-data operators: Arrow text access, word
hashing in numpy, row identity, salted joins and lineage cuts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_root

#: Word separators of the corpus operators: space and tab to carriage return.
SPACES = bytes([32, *range(9, 14)])
#: Texts are handed to numpy in blocks of about this many bytes.
BLOCK_BYTES = 1 << 21

_U = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and drop its lineage: a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver found it (a cluster that
    shares no such path gets the package by ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    return df.mapInArrow(fn, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row: SHA-256 of its id and whole text (null differs from empty). Rows with
    the same key have the same id and the same text."""
    null = F.lit("\x00")
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), null), F.lit("\n"),
                                   F.coalesce(F.col(text_col), null)), 256))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row, __key): every row as one struct beside its identity, so that no column of the caller's is in the way of
    an operator's own; ``select("__row.*")`` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), row_key(id_col, text_col).alias("__key"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Equi-join whose left side may hold one key in a third of its rows: left rows go to one of
    ``salts`` parts by a hash of ``spread``, right rows (at most one a key) to all of them."""
    lhs = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    rhs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [*keys, "__salt"], how).drop("__salt")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about ``limit`` bytes; a longer row is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E6C63D0876A9A35)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=None)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _POWERS[(base, 0)] = have = out
    return have[:n]


#: Odd multipliers of the two independent hash families.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def _segment_hashes(b: np.ndarray, starts: np.ndarray, lens: np.ndarray, word: np.ndarray, family: int) -> np.ndarray:
    nb = b[word]
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    at = np.arange(len(nb)) - np.repeat(first, lens)
    value = byte_values(family)[nb] * powers(BASES[family], int(lens.max()))[at]
    return mix64(np.add.reduceat(value, first) + lens.astype(np.uint64))


def word_hashes(b: np.ndarray, off: np.ndarray, lower: bool = False,
                families: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row.

    Returns the 64-bit hashes of all words (one array a family), the byte start and length of
    each, and row offsets into them.  Works through at most ``2 * BLOCK_BYTES`` at a time unless
    one word is longer.
    """
    if lower:
        b = _LOWER[b]
    word = ~_IS_SPACE[b]
    if not len(b) or not word.any():
        none = np.zeros(0, np.int64)
        return [np.zeros(0, np.uint64)] * families, none, none, np.zeros(len(off), np.int64)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(b)]
    begins[edge] = word[edge]
    starts = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    lens = np.flatnonzero(ends) + 1 - starts
    hashes = []
    for f in range(families):
        parts, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 2 * BLOCK_BYTES)))
            lo, hi = starts[i], starts[j - 1] + lens[j - 1]
            parts.append(_segment_hashes(b[lo:hi], starts[i:j] - lo, lens[i:j], word[lo:hi], f))
            i = j
        hashes.append(np.concatenate(parts))
    return hashes, starts, lens, np.searchsorted(starts, off)


def window_hashes(w: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by differences of a prefix sum of
    word * base**index; multiplying by the inverse power makes it independent of the place."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = BASES[1 - family]
    prefix = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(base, len(w)), out=prefix[1:])
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mix64((prefix[k:] - prefix[:-k]) * inverse)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

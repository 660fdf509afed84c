"""A bit table of fixed size that drops most rows without a partner before they are shuffled for a join.

Tasks set one bit a value in a table of their own and send the parts that are not empty, compressed; the parts are
or-ed by place, and the driver gets ``1 << LOG / 8`` bytes at most, whatever the input.  A value that was
put in is always found; others pass with the probability of the share of set bits, and the join that follows
decides.  So a table that fills up costs shuffle, never rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Logarithm of the number of bits: 16 MB.
LOG = 27
_PART = 1 << 16


def bit_table(values: DataFrame, log: int = LOG) -> np.ndarray:
    """Bits of a one-column table of hashed bigints, as bytes."""
    name = values.columns[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << log) // 8, np.uint8)
        for batch in batches:
            at = batch.column(name).to_numpy() & ((1 << log) - 1)
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = table.reshape(-1, min(_PART, (1 << log) // 8))
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())],
                                         names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column("part").to_pylist(), batch.column("bits")):
                held[i] = held.get(i, np.uint8(0)) | np.frombuffer(zlib.decompress(b.as_buffer()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())],
                                         names=["part", "bits"])

    kind = "part int, bits binary"
    out = np.zeros((1 << log) // 8, np.uint8).reshape(-1, min(_PART, (1 << log) // 8))
    for r in map_batches(map_batches(values, add, kind).repartition("part"), merge, kind).collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each (signed or unsigned 64-bit) value may have been put in."""
    at = values.view(np.int64) & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

"""Bit maps of bounded size that tasks build in segments.

A sift tells which of very many hashed values may be among the wanted ones: it
sits in front of an exact step, so wrong hits cost time, never results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 bits for each wanted value, within these bounds (at most 128 MB).
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
_SEGMENT = 1 << 15


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, its bits) from rows (segment, bit) sorted by segment."""
    now, bits = None, None

    def done() -> pa.RecordBatch:
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([packed], pa.binary())], names=["s", "bits"])

    for batch in batches:
        seg, bit = (batch.column(i).to_numpy() for i in range(2))
        cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if seg[a] != now:
                    if now is not None:
                        yield done()
                    now, bits = int(seg[a]), np.zeros(_SEGMENT, bool)
                bits[bit[a:b]] = True
    if now is not None:
        yield done()


def build(values: DataFrame, column: str, count: int) -> np.ndarray:
    """The bit map of the whole numbers in ``column``, of which there are ``count``."""
    size = MIN_BITS
    while size < min(32 * count, MAX_BITS):
        size *= 2
    cell = F.pmod(F.col(column).cast("long"), F.lit(size))
    rows = (values.select(F.floor(cell / _SEGMENT).cast("int").alias("s"), (cell % _SEGMENT).cast("int").alias("bit"))
            .repartition("s").sortWithinPartitions("s").mapInArrow(_segments, "s bigint, bits binary"))
    bits = np.zeros(size // 8, np.uint8)
    for row in rows.toLocalIterator():                   # at most MAX_BITS / 8 bytes in all
        bits[row.s * _SEGMENT // 8:(row.s + 1) * _SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in the bit map (two's complement for negative ones)."""
    cell = values.astype(np.int64).view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0

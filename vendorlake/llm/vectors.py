"""Sums of long count vectors over all tasks.

A task adds up its own vector and emits it in slices; the slices of all tasks
are added in two steps, so that no task reads those of the whole corpus.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 14                          # counts in a slice
ROWS = "name string, slice bigint, counts binary"
_SALTS = 32


def slices(name: str, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The vector ``name`` of a task as rows; slices of zeros are left out."""
    for i in range(0, len(counts), SLICE):
        part = counts[i:i + SLICE]
        if part.any():
            yield _row(name, i // SLICE, part.astype(np.int64))


def _row(name: str, at: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([at], pa.int64()),
                                       pa.array([counts.tobytes()], pa.binary())], names=["name", "slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of a slice."""
    now, total = None, None
    for batch in batches:
        for name, at, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (name, at) != now:
                if now is not None:
                    yield _row(*now, total)
                now, total = (name, at), np.zeros(len(counts) // 8, np.int64)
            total += np.frombuffer(counts, np.int64)
    if now is not None:
        yield _row(*now, total)


def added(rows: DataFrame) -> DataFrame:
    """(name, slice, counts) with one row for each slice of each name."""
    salted = rows.withColumn("salt", F.spark_partition_id() % _SALTS)
    some = (salted.repartition("name", "slice", "salt").sortWithinPartitions("name", "slice")
            .select("name", "slice", "counts").mapInArrow(_add, ROWS))
    return some.repartition("name", "slice").sortWithinPartitions("name", "slice").mapInArrow(_add, ROWS)


def counts(rows: DataFrame) -> DataFrame:
    """(name, at, n) for the counts above 0 of the rows of ``added``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = np.frombuffer(held, np.int64)
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found + at * SLICE),
                                                  pa.array(n[found])], names=["name", "at", "n"])
    return rows.mapInArrow(run, "name string, at bigint, n bigint")

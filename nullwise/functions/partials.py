"""Sums over a table that SQL aggregates cannot hold (matrices, stacks of gradients).

``partial_sums`` lets every task add up its rows in NumPy and return one
pickled result; ``added_up`` adds the results ``fan`` at a time over the
cluster, so neither a task nor the driver holds more than ``fan`` of them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN = 32
BLOCK_ROWS = 4096


def plus(a: tuple, b: tuple) -> tuple:
    """Entrywise sum of two results."""
    return tuple(x + y for x, y in zip(a, b))


def _pickled(total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of ``width`` doubles (missing entries: nan)."""
    flat = column.flatten()
    if flat.null_count:
        flat = flat.cast(pa.float64()).fill_null(np.nan)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def partial_sums(rows: DataFrame, of_block: Callable[[pa.RecordBatch], tuple], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per task: the sum of ``of_block`` over its blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = of_block(batch.slice(at, block_rows))
                total = part if total is None else plus(total, part)
        if total is not None:
            yield _pickled(total)

    return rows.mapInArrow(run, "part binary")


def added_up(partials: DataFrame, fan: int = FAN) -> tuple | None:
    """The sum of all partial results; None without any."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = pickle.loads(x.as_py())
                total = part if total is None else plus(total, part)
        if total is not None:
            yield _pickled(total)

    n = partials.rdd.getNumPartitions()  # planning only
    while n > fan:
        n = math.ceil(n / fan)
        partials = partials.repartition(n).mapInArrow(together, "part binary")
    total = None
    for row in partials.collect():
        part = pickle.loads(row["part"])
        total = part if total is None else plus(total, part)
    return total

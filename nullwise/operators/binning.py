"""Features in at most 255 bins, one byte each, for the learners that split on histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partials import matrix
from ..session import stored

#: The bin of missing cells; values take the bins below.
MISSING = 255
_FEATURES_PER_JOB = 200
#: Rows for which a task of its own pays: an iterative learner scans its rows hundreds of times.
ROWS_PER_TASK = 50_000
#: Rows of a stored block, few enough that a feature's numbers stay in the processor's cache.
BLOCK = 16_384


def as_array(df: DataFrame, features: str) -> Column:
    """The feature column as an array of doubles (a vector, or an array that may hold nulls)."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


@dataclass
class Bins:
    """Ascending edges per feature: bin b holds values up to edge b, the last bin all above."""

    edges: list[np.ndarray]

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) bytes."""
        out = np.empty(x.shape, np.uint8, order="F")  # learners read feature by feature
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], "left"))
        return out


@dataclass
class Binned:
    """The stored training rows in blocks of up to BLOCK: ``bins`` (one byte per row, feature after feature), ``y`` (class from 0)."""

    table: DataFrame
    bins: Bins
    p: int
    counts: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.counts)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows in even parts, one for each ROWS_PER_TASK of the ``n``; as they lie if one is enough."""
    tasks = even_tasks(rows, n)
    return rows.repartition(tasks) if tasks > 1 else rows


def even_tasks(rows: DataFrame, n: int) -> int:
    """One for each ROWS_PER_TASK of the ``n`` rows; above the number of cores a multiple of it, so that none waits for a last few."""
    tasks, cores = max(1, math.ceil(n / ROWS_PER_TASK)), rows.sparkSession.sparkContext.defaultParallelism
    return tasks if tasks <= cores else math.ceil(tasks / cores) * cores


def fit_bins(rows: DataFrame, p: int) -> Bins:
    """Edges at the 255 quantiles of column ``x`` (a mergeable sketch), the largest left out: fewer values keep a bin each."""
    edges = []
    for at in range(0, p, _FEATURES_PER_JOB):
        cells = [F.nanvl(F.get("x", F.lit(j)), F.lit(None)) for j in range(at, min(at + _FEATURES_PER_JOB, p))]
        probs = [i / (MISSING - 1) for i in range(MISSING)]
        row = rows.agg(*[F.percentile_approx(c, probs, 20_000).alias(f"e{j}") for j, c in enumerate(cells)]).first()
        edges += [np.unique(np.array(e or [], float))[:-1] for e in row]
    return Bins(edges)


def binned(df: DataFrame, label: str, features: str) -> Binned:
    """The rows with a label, binned and stored once."""
    rows = stored(df.select(as_array(df, features).alias("x"), F.col(label).cast("int").alias("y")).where("x is not null and y is not null"), "raw")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row per class
    p = rows.agg(F.max(F.size("x")).alias("p")).first()["p"] or 0
    bins = fit_bins(rows, p) if p else Bins([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((bins.of(matrix(part.column(0), p)), part.column(1).to_numpy().astype(np.int32)))
                n += part.num_rows
                if n >= BLOCK:
                    b, y = (np.concatenate(c) for c in zip(*held))
                    yield block_row(bins=b[:BLOCK], y=y[:BLOCK])
                    held, n = [(b[BLOCK:], y[BLOCK:])], n - BLOCK
        if n:
            b, y = (np.concatenate(c) for c in zip(*held))
            yield block_row(bins=b, y=y)

    tasks = even_tasks(rows, sum(counts.values()))
    # dealt evenly: the raw rows may lie in a few large files
    dealt = rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)
    table = stored(dealt.mapInArrow(run, "bins binary, y binary"), "binned")
    return Binned(table, bins, p, np.array([counts.get(c, 0) for c in range(max(counts, default=0) + 1)], float))


def block_row(**columns: np.ndarray) -> pa.RecordBatch:
    """One row holding a block: every column's numbers as bytes, a matrix column after column."""
    return pa.RecordBatch.from_arrays([pa.array([c.T.tobytes()], pa.binary()) for c in columns.values()], names=list(columns))


def blocks(batch: pa.RecordBatch, p: int) -> Iterator[tuple]:
    """(bins: rows x p bytes, y, bytes of further columns ...) of every block of stored rows."""
    for row in zip(*(c for c in batch.columns)):
        y = np.frombuffer(row[1].as_buffer(), np.int32)
        yield (np.frombuffer(row[0].as_buffer(), np.uint8).reshape(p, len(y)).T, y, *(np.frombuffer(c.as_buffer(), np.float64) for c in row[2:]))


def array_udf(of_matrix):
    """A column function: of_matrix(rows x features) -> rows x values, over an array column."""
    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(of_matrix(np.array(x.tolist(), dtype=float))))
    return apply


def with_probabilities(df: DataFrame, probabilities, features: str) -> DataFrame:
    """df with ``probs`` = probabilities(matrix of the features) and ``prediction``, the first of the largest."""
    out = df.withColumn("probs", array_udf(probabilities)(as_array(df, features)))
    return out.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))

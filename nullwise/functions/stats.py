"""Correlations of many column pairs over their pairwise-complete rows, in one scan.

Each block of rows gives, for all pairs at once, the number of rows that have
both columns, the means of either column over them, and the sums of squares
and products about these means: five matrix products of values and presence.
Two blocks' moments are combined by shifting them to the common mean, so
large means cancel no digits and no pass for the means is needed; they meet
over the cluster as p x p matrices, whatever the patterns of missing cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partials import added_up, matrix, partial_sums

#: A spread below this share of the mean, or of what the squares were computed from, is rounding noise: the side is constant.
_FLAT = 1e-12


@dataclass
class Moments:
    """For columns i, j over the rows that have both: count, mean of i, squares of i and products about the means,
    and the squares of i from which those were computed."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a block (nan: missing)."""
        have = ~np.isnan(x)
        m = have.astype(float)
        centre = np.where(have, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1.0)
        c = np.where(have, x - centre, 0.0)
        n, total = m.T @ m, c.T @ m
        some = np.maximum(n, 1.0)
        raw = (c * c).T @ m
        return cls(n, centre[:, None] + total / some, np.maximum(raw - total * total / some, 0.0), c.T @ c - total * total.T / some, raw)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        weight = self.n * other.n / some
        mean = np.where(self.n > 0, self.mean + apart * other.n / some, other.mean)
        between = apart * apart * weight
        return Moments(n, mean, self.square + other.square + between, self.product + other.product + apart * apart.T * weight,
                       self.raw + other.raw + between)

    def correlations(self) -> np.ndarray:
        """Pearson correlations; nan where fewer than two rows have both or a side is constant."""
        some = np.maximum(self.n, 1.0)
        flat = (self.square / some <= (_FLAT * self.mean) ** 2) | (self.square <= _FLAT * self.raw)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.product / np.sqrt(self.square * self.square.T)
        return np.where((self.n > 1) & ~flat & ~flat.T, np.clip(r, -1.0, 1.0), np.nan)


def pair_moments(df: DataFrame, cols: list[str]) -> Moments:
    """The moments of all pairs of ``cols`` (null and nan: missing)."""
    p = len(cols)
    cells = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))

    def of_block(batch: pa.RecordBatch) -> tuple:
        return (Moments.of(matrix(batch.column(0), p)),)

    found = added_up(partial_sums(cells, of_block))
    return found[0] if found else Moments.of(np.zeros((0, p)))


def corr_long(df: DataFrame, pairs: list[tuple[tuple, str, str]], names: list[str],
              value: str = "value") -> DataFrame:
    """Pearson correlation of many column pairs (pairwise-complete rows), returned long.

    ``pairs`` holds (labels, column_a, column_b); the result has ``names``
    (one per label) and ``value``; a pair with a constant side gives NULL.
    """
    cols = sorted({c for _, a, b in pairs for c in (a, b)})
    at = {c: i for i, c in enumerate(cols)}
    r = pair_moments(df, cols).correlations()
    rows = [(*labels, None if np.isnan(v := r[at[a], at[b]]) else float(v)) for labels, a, b in pairs]  # a row per pair of columns
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + f", {value} double")

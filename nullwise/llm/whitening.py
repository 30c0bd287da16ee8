"""Embedding whitening: exact distributed covariance, a symmetric eigensolver, broadcast projection.

1. Every component c becomes the whole number x = floor(64 c) + 1,000,000.
   One pass counts the vectors and sums them, a second sums the products of
   x - m, where m is the mean rounded to whole numbers.  All sums are whole
   numbers without rounding, merged over the cluster in groups, and
   the remaining fraction of the mean is taken out exactly, so the
   covariance matrix is rounded once, at the end.
2. The matrix has one row per dimension, whatever the number of vectors, and
   is decomposed on the driver: Householder reflections make it tridiagonal,
   Sturm counts bisect the leading eigenvalues, inverse iteration gives their
   vectors, and vectors of eigenvalues closer than CLOSE of the norm are made
   orthogonal to each other at every step.
3. The projection (components x dimensions) is broadcast; vectors are whitened
   where they are.  A last pass measures the covariance of the result.

The vectors are read four times and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nullwise.functions.partials import BLOCK_ROWS, added_up, matrix, partial_sums

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Longest vectors: the driver holds a few matrices of this many rows and columns (128 MB each), the broadcast COMPONENTS rows.
MAX_DIMENSIONS = 4096
#: Components whose eigenvalue is below this share of the first have no defined scale and are left out.
LEAST_SHARE = 1e-10
#: Eigenvalues closer than this share of the norm are a cluster.
CLOSE = 1e-3
_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflectors) of a symmetric matrix, by Householder reflections.

    Reflector k acts on the rows from k + 1; an empty one does nothing.
    """
    a = a.astype(float, copy=True)
    n = len(a)
    off, reflectors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if k == n - 2 or length <= abs(x[0]):  # nothing below the off-diagonal
            off[k] = x[0]
            reflectors.append(np.zeros(0))
            continue
        off[k] = -math.copysign(length, x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        p -= (p @ x) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        reflectors.append(x)
    return a.diagonal().copy(), off, reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of the tridiagonal matrix below each of ``at`` (signs of a Sturm sequence)."""
    tiny = _EPS * _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    q = diagonal[0] - at
    below = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) <= tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bit."""
    n = len(diagonal)
    radius = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    high += _EPS * np.abs(high) + np.finfo(float).tiny
    wanted = n - np.arange(k)  # so many eigenvalues lie at or below the one looked for
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        under = count_below(diagonal, off, middle) >= wanted
        high = np.where(open_ & under, middle, high)
        low = np.where(open_ & ~under, middle, low)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges; a zero pivot counts as tiny."""
    n = len(diagonal)
    main, above, second, z = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    for i, below in enumerate(off.tolist()):
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], main[i + 1], above[i] = below, above[i] - factor * main[i + 1], main[i + 1]
            second[i] = above[i + 1]
            above[i + 1] *= -factor
            z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
        else:
            main[i] = main[i] or tiny
            factor = below / main[i]
            main[i + 1] -= factor * above[i]
            z[i + 1] -= factor * z[i]
    for i in range(n - 1, -1, -1):
        rest = z[i] - (above[i] * z[i + 1] if i + 1 < n else 0) - (second[i] * z[i + 2] if i + 2 < n else 0)
        pivot = main[i] if abs(main[i]) > tiny else math.copysign(tiny, main[i])
        z[i] = rest / pivot
    out = np.array(z)
    return out / np.abs(out).max()


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector per value (falling), as rows, by inverse iteration."""
    n, rng = len(diagonal), np.random.default_rng(11)
    norm = max(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0), np.finfo(float).tiny)
    out = np.zeros((len(values), n))
    first, shift = 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first = j
        shift = min(value, shift - 10 * _EPS * norm) if j > first else value  # equal ones get shifts of their own
        z = rng.standard_normal(n)
        for _ in range(6):
            z = _solved(diagonal, off, shift, z, _EPS * norm)
            for _ in range(2):
                z -= out[first:j].T @ (out[first:j] @ z)
            z /= np.linalg.norm(z)
        out[j] = z
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of the k largest of a symmetric matrix.

    A vector's entry of largest size is positive.
    """
    scale = np.abs(v).max(initial=0)
    if not len(v) or not scale:
        return np.zeros(0), np.zeros((0, len(v)))
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        if len(x := reflectors[at]):
            vectors[:, at + 1:] -= 2 * np.outer(vectors[:, at + 1:] @ x, x)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.sign(largest)[:, None]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers without rounding, as Python numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _whole(part: pa.RecordBatch, d: int) -> np.ndarray:
    """x = floor(SCALE c) + SHIFT of the rows, as long."""
    return np.floor(SCALE * matrix(part.column(part.schema.get_field_index("v")), d)).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, d: int, of_block) -> tuple | None:
    """Sum of of_block(x) over all rows."""
    return added_up(partial_sums(rows.select("v"), lambda part: of_block(_whole(part, d)), BLOCK_ROWS))


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors of ``d`` numbers with sums ``total``, eigenvalues and components (rows)."""

    n: int
    d: int
    total: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The mean rounded to whole numbers."""
        return np.array([(2 * int(s) + self.n) // (2 * self.n) for s in self.total], dtype=np.int64)

    def scaled_deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S without rounding: long, or Python numbers where long is too short."""
        y = x - self.centre
        rest = np.array([int(s) - self.n * int(m) for s, m in zip(self.total, self.centre)])  # below n in size
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return self.n * y - rest
        return self.n * y.astype(object) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        exact = (self.scaled_deviations(x) / self.n).astype(float)
        return exact @ (self.components / np.sqrt(self.values)[:, None]).T


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors without missing or non-finite numbers, all of the most common length (of equally common ones the least)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(v) == F.lit(length["d"] if length else 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of ``rows`` (as from usable_vectors); None without vectors."""
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} numbers: whitening holds {MAX_DIMENSIONS} x {MAX_DIMENSIONS} on the driver at most")
    n, total = _summed(rows, d, lambda x: (len(x), x.astype(object).sum(axis=0)))
    model = Whitening(n, d, total, np.zeros(0), np.zeros((0, d)), 0.0)
    centre = model.centre
    products, = _summed(rows, d, lambda x: (exact_products(x - centre),))
    rest = np.array([int(s) - n * int(m) for s, m in zip(total, centre)], dtype=object)
    exact = n * products - np.outer(rest, rest)  # n * n times the covariance
    v = np.array([[int(x) / (n * n) for x in row] for row in exact])
    values, vectors = leading_components(v, components)
    real = values > LEAST_SHARE * values.max(initial=0)
    model.values, model.components = values[real], vectors[real]
    model.trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
    return model


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of every vector."""
    shared, d = rows.sparkSession.sparkContext.broadcast(model), model.d
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
            x = _whole(part, d)
            scaled = m.scaled_deviations(x)
            most = int(np.abs(scaled).max(initial=0))
            if most * most * d < 1 << 63:
                deviation = pa.array((scaled * scaled).sum(axis=1)).cast(kind)
            else:
                deviation = pa.array([int(s) for s in (scaled.astype(object) ** 2).sum(axis=1)], kind)
            w = m.whitened(x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                                             names=["id", "deviation", "whitened"])

    kind_of_id = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind_of_id}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened vectors' covariance minus the identity, measured over all of them."""
    shared, d, k = rows.sparkSession.sparkContext.broadcast(model), model.d, len(model.values)

    def of_block(x: np.ndarray) -> tuple:
        w = shared.value.whitened(x)
        return w.sum(axis=0), w.T @ w

    total, products = _summed(rows, d, of_block)
    mean = total / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is null, empty or holds a null or non-finite number is left
    out, and so is one of another length than most.  Repeated rows and rows
    without an id count like all others.  Components whose eigenvalue is not
    above LEAST_SHARE of the first are left out: vectors that are all equal
    give no rows, and neither does an empty table.  Other columns are neither
    read nor returned.
    """
    rows = usable_vectors(vectors, id_col, vector_col)
    model = fit(rows, components)
    kind = vectors.schema[id_col].dataType
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind.simpleString()}, component int, n long, deviation decimal(38,0), "
                                                        "whitened double, explained double, identity_error double")
    error = identity_error(rows, model)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = apply(rows, model).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))

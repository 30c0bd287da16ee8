"""Scaling and feature construction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binning import array_udf


@dataclass
class StandardModel:
    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, (m, s) in self.stats.items()})


class Standardizer:
    """train mean and *population* deviation; a zero deviation divides by 1."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> StandardModel:
        aggs = []
        for i, c in enumerate(self.cols):
            aggs += [F.avg(F.col(c).cast("double")).alias(f"_m{i}"),
                     F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}")]
        row = df.agg(*aggs).first()
        stats = {}
        for i, c in enumerate(self.cols):
            m, s = row[f"_m{i}"], row[f"_s{i}"]
            stats[c] = (m if m is not None else 0.0, s if s else 1.0)
        return StandardModel(stats)


def _bspline2(u):
    """Cardinal quadratic B-spline of u (support [0, 3))."""
    return (F.when((u >= 0) & (u < 1), u * u / 2)
            .when((u >= 1) & (u < 2), (-2 * u * u + 6 * u - 3) / 2)
            .when((u >= 2) & (u < 3), (3 - u) * (3 - u) / 2)
            .otherwise(F.lit(0.0)))


@dataclass
class SplineModel:
    ranges: dict[str, tuple[float, float]]
    n_knots: int = 3

    def n_outputs(self) -> int:
        # n_knots + degree - 1 basis functions, the last one dropped (no bias)
        return self.n_knots + 2 - 1 - 1

    def transform(self, df: DataFrame, keep_input: bool = False) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.ranges.items():
            h = (hi - lo) / (self.n_knots - 1) if hi > lo else 1.0
            x = F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))  # constant beyond ends
            for j in range(self.n_outputs()):
                t_j = lo - 2 * h + j * h
                u = (x - F.lit(t_j)) / F.lit(h)
                out[f"{c}_sp{j}"] = F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(_bspline2(u))
        res = df.withColumns(out)
        return res if keep_input else res.drop(*self.ranges.keys())

    def assembled(self, df: DataFrame, out: str) -> DataFrame:
        """df with the basis of all columns as one vector: the numbers of ``transform``, a batch at a time in NumPy (as
        column expressions they outgrow Spark's generated code).  A missing cell is an error."""
        ranges, n_knots, n_out = list(self.ranges.values()), self.n_knots, self.n_outputs()

        def basis(x: np.ndarray) -> np.ndarray:
            cells = np.empty((len(x), len(ranges) * n_out))
            for i, (lo, hi) in enumerate(ranges):
                h = (hi - lo) / (n_knots - 1) if hi > lo else 1.0
                v = np.where(np.isnan(x[:, i]), hi, np.minimum(np.maximum(x[:, i], lo), hi))  # nan counts as above all
                for j in range(n_out):
                    u = (v - (lo - 2 * h + j * h)) / h
                    cells[:, i * n_out + j] = np.select(
                        [(u >= 0) & (u < 1), (u >= 1) & (u < 2), (u >= 2) & (u < 3)],
                        [u * u / 2, (-2 * u * u + 6 * u - 3) / 2, (3 - u) * (3 - u) / 2], 0.0)
            return cells

        cells = [F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"missing cell in {c}")).cast("double")) for c in self.ranges]
        return df.withColumn(out, array_to_vector(array_udf(basis)(F.array(*cells))))


class SplineBasis:
    """quadratic spline basis, uniform knots between train min and max."""

    def __init__(self, cols: list[str], n_knots: int = 3):
        self.cols, self.n_knots = list(cols), n_knots

    def fit(self, df: DataFrame) -> SplineModel:
        aggs = []
        for i, c in enumerate(self.cols):
            aggs += [F.min(F.col(c).cast("double")).alias(f"_lo{i}"),
                     F.max(F.col(c).cast("double")).alias(f"_hi{i}")]
        row = df.agg(*aggs).first()
        return SplineModel({c: (row[f"_lo{i}"] or 0.0, row[f"_hi{i}"] or 0.0)
                            for i, c in enumerate(self.cols)}, self.n_knots)


def append_features(df: DataFrame, extra: DataFrame, key: str = "row_id",
                    check: bool = False) -> DataFrame:
    """add externally produced columns by key (left join, one row per key).

    The positional ``hstack`` of the source becomes a keyed join; with
    ``check=True`` a count confirms that no row was duplicated.
    """
    out = df.join(extra, key, "left")
    if check:
        n_in, n_out = df.count(), out.count()
        if n_in != n_out:
            raise ValueError(f"append_features changed the row count: {n_in} -> {n_out}")
    return out

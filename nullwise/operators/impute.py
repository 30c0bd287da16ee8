"""Imputation (I1, I2, I5; I4 chained equations).

Fit steps return one number per column to the driver; transforms are
``coalesce`` expressions.  The median is exact and distributed
(``exact_quantiles``): Spark's ``ml.feature.Imputer`` is approximate and the
exact ``median`` aggregate keeps a column's distinct values in one buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in cols])).alias("x")).select("x.feature", "x.value"))


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median) for every listed column, exact, nulls ignored."""
    q = exact_quantiles(_long(df, cols), ["feature"], "value", [0.5])
    return q.select("feature", F.col("value").alias("median"))


@dataclass
class FillModel:
    fills: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v))
                               for c, v in self.fills.items() if v is not None})


class MedianImputer:
    """Exact median learned on train, applied to any split."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> FillModel:
        rows = column_medians(df, self.cols).collect()  # one row per column
        found = {r["feature"]: r["median"] for r in rows}
        return FillModel({c: found.get(c) for c in self.cols})


class MeanImputer:
    """Mean fill (used for class centres)."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> FillModel:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}")
                       for i, c in enumerate(self.cols)]).first()
        return FillModel({c: row[f"_{i}"] for i, c in enumerate(self.cols)})


def mean_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return MeanImputer(cols).fit(df).transform(df)


@dataclass
class MissingAwareModel:
    sentinels: dict[str, float]
    suffix: str = "_missing"

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, s in self.sentinels.items():
            out[c + self.suffix] = F.col(c).isNull().cast("double")
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(s))
        return df.withColumns(out)


def fit_missing_aware(df: DataFrame, cols: list[str]) -> MissingAwareModel:
    """MLlib trees reject NaN, so a missing cell becomes an indicator plus a
    sentinel below the column's range: one split isolates the missing rows."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(c).cast("double")).alias(f"_lo{i}"),
                 F.max(F.col(c).cast("double")).alias(f"_hi{i}")]
    row = df.agg(*aggs).first()
    sent = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"_lo{i}"], row[f"_hi{i}"]
        sent[c] = -1.0 if lo is None else lo - (hi - lo) - 1.0
    return MissingAwareModel(sent)

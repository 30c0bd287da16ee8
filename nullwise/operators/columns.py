"""Projections and row filters (P1-P12).  All are plain projections or
filters, so Catalyst prunes the scan's columns and pushes the predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def variant(df: DataFrame, exclude) -> DataFrame:
    """A feature variant = the table minus a column family / leaky columns."""
    return drop_columns(df, exclude)


def feature_columns(df: DataFrame, targets, key: str = "row_id") -> list[str]:
    """Every column that is neither a target nor the key, in schema order."""
    t = set(targets)
    return [c for c in df.columns if c not in t and c != key]


def all_null_columns(df: DataFrame, cols=None) -> list[str]:
    """Fit step of P4: columns whose every value is null (one aggregate)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"_{i}"] == 0]


def drop_all_null(df: DataFrame, cols=None) -> DataFrame:
    """Drop columns with no value at all."""
    return df.drop(*all_null_columns(df, cols))


def column_kinds(df: DataFrame, cols=None) -> dict[str, str]:
    """P5: 'numeric' or 'string' per column, from the schema."""
    cols = set(cols or df.columns)
    out = {}
    for f in df.schema.fields:
        if f.name in cols:
            out[f.name] = "numeric" if isinstance(f.dataType, NUMERIC) else (
                "string" if isinstance(f.dataType, T.StringType) else "other")
    return out


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns only."""
    ex = set(exclude)
    return [c for c, k in column_kinds(df).items() if k == "numeric" and c not in ex]


def existing(df: DataFrame, names) -> list[str]:
    """The part of a wish list that exists, in wish-list order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def require_label(df: DataFrame, target: str) -> DataFrame:
    """Drop rows whose label is missing (pushed to the scan as IsNotNull)."""
    return df.where(F.col(target).isNotNull())


def project_features(df: DataFrame, names, key: str = "row_id") -> DataFrame:
    """P10: keep the key and the selected features."""
    return df.select(key, *names)


def keep_classes(df: DataFrame, label: str, classes: DataFrame, class_col: str | None = None) -> DataFrame:
    """Left-semi join against a class table (small: one row per class)."""
    class_col = class_col or label
    cl = classes.select(F.col(class_col).alias(label)).distinct()
    return df.join(F.broadcast(cl), label, "left_semi")


def tag(df: DataFrame, **consts) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})

"""Missing-value profiling (M1-M6).

Every profile is one scan: one aggregate over all columns (partial
aggregation on the map side, a single-row final merge), never one job per
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import corr_long


def _cols(df: DataFrame, cols) -> list[str]:
    return [c for c in (cols or df.columns) if c != "row_id"]


def _quoted(cols: list[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in cols]


def missing_profile(df: DataFrame, cols=None, digits: int = 6) -> DataFrame:
    """(feature, n_missing, pct_missing) for each column, in one scan; an empty table has pct_missing null."""
    cols = _cols(df, cols)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_v{i}") for i, c in enumerate(_quoted(cols))])
    long = counts.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col("_n") - F.col(f"_v{i}")).alias("n_missing"))
        for i, c in enumerate(cols)])).alias("x")).select("_n", "x.*")
    return long.select(
        "feature", F.col("n_missing").cast("long").alias("n_missing"),
        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("_n")), digits).alias("pct_missing"))


def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """Columns with any missing value, highest share first."""
    return (missing_profile(df, cols).where(F.col("n_missing") > 0)
            .orderBy(F.desc("pct_missing"), "feature"))


def missing_total(df: DataFrame, cols=None, digits: int = 6) -> DataFrame:
    """Cells, missing cells and missing rate of the whole table."""
    cols = _cols(df, cols)
    miss = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("n_missing"))
            .select(F.col("n_rows").cast("long"), F.lit(len(cols)).cast("long").alias("n_cols"),
                    (F.col("n_rows") * len(cols)).cast("long").alias("n_cells"),
                    F.coalesce(F.col("n_missing"), F.lit(0)).cast("long").alias("n_missing"))
            .withColumn("pct_missing",
                        F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_cells")), digits)))


def missing_matrix(df: DataFrame, cols=None, key: str = "row_id") -> DataFrame:
    """Long missingness matrix (row_id, feature, is_missing): a pure projection."""
    cols = [c for c in _cols(df, cols) if c != key]
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).isNull().cast("int").alias("is_missing"))
        for c in cols])).alias("x")
    return df.select(key, cells).select(key, "x.feature", "x.is_missing")


def missing_patterns(df: DataFrame, cols=None) -> DataFrame:
    """Rows per null pattern: the scalable form of the missingness matrix.

    ``pattern`` has one character per column, in ``cols`` order: '1' missing.
    """
    cols = _cols(df, cols)
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return (df.select(pattern.alias("pattern")).groupBy("pattern")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows")))


def columns_with_missing(df: DataFrame, cols=None) -> list[str]:
    """Fit step of M5: names of columns with at least one null (one scan)."""
    cols = _cols(df, cols)
    prof = missing_profile(df, cols).where(F.col("n_missing") > 0).select("feature").collect()
    found = {r["feature"] for r in prof}
    return [c for c in cols if c in found]


def missing_indicators(df: DataFrame, cols: list[str], key: str = "row_id",
                       suffix: str = "_missing") -> DataFrame:
    """0/1 double indicator per listed column (usually ``columns_with_missing``)."""
    return df.select(key, *[F.col(c).isNull().cast("double").alias(c + suffix) for c in cols])


def missing_target_corr(df: DataFrame, cols: list[str], targets: list[str],
                        digits: int = 8) -> DataFrame:
    """Correlation of each missing indicator with each numeric target, one aggregate.

    Undefined correlations (constant indicator on the pairwise-complete rows)
    are dropped.
    """
    ind = df.select(*[F.col(c).isNull().cast("double").alias(f"_m{i}") for i, c in enumerate(cols)],
                    *[F.col(t).cast("double").alias(f"_t{j}") for j, t in enumerate(targets)])
    pairs = [((c, t), f"_m{i}", f"_t{j}") for i, c in enumerate(cols) for j, t in enumerate(targets)]
    long = corr_long(ind, pairs, ["feature", "target"], "corr")
    return (long.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
            .select("feature", "target", F.round("corr", digits).alias("corr")))

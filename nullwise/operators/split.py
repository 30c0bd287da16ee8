"""Deterministic splitting and sampling.

Every random choice is an md5 hash of ``seed|row_id``, so results do not
depend on partitioning, input order or the engine.  The order key is the
first 15 hex digits of that hash (a 60-bit integer) with ``row_id`` as tie
breaker.  Per-class ranks come from ``rank_within_groups``, which numbers
rows inside (class, hash range) windows: a class holding most rows is
spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import rank_within_groups
from .encode import compact_labels


def hash_key(seed: int, key: str = "row_id"):
    """60-bit order key from md5(seed|key); same order as the 15-char hex prefix."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def class_quotas(counts: DataFrame, label: str, frac: float) -> DataFrame:
    """Per-class test quota: floor(frac*n) plus one for the largest remainders.

    The total is exactly ceil(frac*N); remainder ties go to the smaller label.
    ``counts`` has one row per class (bounded), so the global windows are tiny.
    """
    f = F.lit(float(frac))
    base = counts.withColumn("_base", F.floor(F.col("n") * f).cast("long")) \
                 .withColumn("_rem", F.col("n") * f - F.floor(F.col("n") * f))
    w_all = Window.partitionBy()
    tot = base.withColumn("_total", F.ceil(F.sum("n").over(w_all) * f).cast("long")) \
              .withColumn("_extra", F.col("_total") - F.sum("_base").over(w_all))
    order = F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(label)))
    return tot.withColumn("quota", F.col("_base") + F.when(order <= F.col("_extra"), 1).otherwise(0)) \
              .select(label, "n", "quota")


def stratified_split(df: DataFrame, label: str, frac: float = 0.2, seed: int = 42,
                     key: str = "row_id", out: str = "split") -> DataFrame:
    """Exact stratified split; rows with a null label are not assigned.

    Adds ``split`` ('train'/'test') to every labelled row.
    """
    lab = df.where(F.col(label).isNotNull())
    counts = lab.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    quotas = class_quotas(counts, label, frac).select(label, "quota")
    ranked = rank_within_groups(lab.withColumn("_h", hash_key(seed, key)), [label], "_h", key)
    # one row per class: bounded by the encoder's category cap
    j = ranked.join(F.broadcast(quotas), label, "inner")
    return (j.withColumn(out, F.when(F.col("_rank") < F.col("quota"), "test").otherwise("train"))
            .drop("_h", "_rank", "quota"))


def assign_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42,
                 key: str = "row_id", out: str = "fold") -> DataFrame:
    """T4: stratified k-fold id = rank within class mod k (feeds CrossValidator.foldCol)."""
    lab = df.where(F.col(label).isNotNull())
    ranked = rank_within_groups(lab.withColumn("_h", hash_key(seed, key)), [label], "_h", key)
    return ranked.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_h", "_rank")


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """T5: n rows without replacement, a deterministic shuffle then truncation.

    Planned as TakeOrderedAndProject: every partition keeps its own first n,
    so only n rows per partition reach the final merge.
    """
    return (df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h"))


def drop_rare_classes(train: DataFrame, test: DataFrame, label: str, min_count: int = 5,
                      out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes with fewer than ``min_count`` train rows leave both splits; then E6."""
    keep = (train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_count).select(label))
    tr = train.join(F.broadcast(keep), label, "left_semi")
    te = test.join(F.broadcast(keep), label, "left_semi")
    return compact_labels(tr, te, label, out)

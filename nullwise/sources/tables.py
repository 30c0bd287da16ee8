"""Readers for the input tables (Parquet, one folder or file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# hash key used to spread a table that arrives in fewer splits than there are cores
KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey",
        "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it.

    A file with a single row group is one scan split, so every narrow step
    after it would run in one task.  When the scan has fewer splits than the
    session's default parallelism, the table is hash-partitioned on its key
    (orders and lineitem on the order key, so later joins and aggregates by
    order reuse the partitioning).  Large inputs already have many splits
    and are left untouched: the check is planning only, no job runs.
    Off by default: measured locally, the extra shuffle costs more than the
    parallelism it buys on these small files.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    if spread and name in KEYS:
        target = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            df = df.repartition(target, KEYS[name])
    return df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every input table as a temp view (SQL users)."""
    for name in names:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            table(spark, sf_dir, name).createOrReplaceTempView(name)

"""Sources and sinks (S1-S5): Parquet/CSV in, Parquet partitioned by split and
CSV reports out.  Spark has no spreadsheet reader; tables arrive as Parquet
or CSV with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cases(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Lazy scan of the raw case table with an explicit schema (no inference)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", options.get("header", "true"))
    return r.load(path)


class DictionaryError(ValueError):
    pass


def load_dictionary(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """(variable, explanation) from a dictionary table.

    The two columns are found by case-insensitive substring ('variable',
    'explanation'); names are trimmed, blank names dropped, and for a name
    listed twice the last row (in ``order_col`` order, else load order) wins.
    """
    cols = {c.lower(): c for c in df.columns}
    var = next((c for lc, c in cols.items() if "variable" in lc), None)
    exp = next((c for lc, c in cols.items() if "explanation" in lc), None)
    if var is None or exp is None:
        raise DictionaryError(f"no variable/explanation columns in {df.columns}")
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    d = df.select(F.trim(F.col(var).cast("string")).alias("variable"),
                  F.trim(F.col(exp).cast("string")).alias("explanation"), order.alias("_o"))
    d = d.where(F.col("variable").isNotNull() & (F.col("variable") != ""))
    w = Window.partitionBy("variable").orderBy(F.desc("_o"))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_o")


def dictionary_map(d: DataFrame) -> dict[str, str]:
    """The dictionary as a driver map (one entry per variable: bounded by the schema)."""
    return {r["variable"]: r["explanation"] for r in d.collect()}


def write_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One Parquet dataset partitioned by split; names live in the schema."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None,
               split_col: str = "split") -> DataFrame:
    """S3: read one split; the filter prunes partitions (folders) at planning time."""
    df = spark.read.parquet(path)
    return df.where(F.col(split_col) == split) if split else df


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; array/map/struct columns are written as JSON text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    df.select(*out).write.mode(mode).option("header", True).csv(path)

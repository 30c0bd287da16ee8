"""Fitted transforms on streams.

Every fitted transform in the library (encoding plans, fill models,
standardisers, spline bases, reply parsing) is a projection of column
expressions, so the same object applies unchanged to a streaming
DataFrame: fit on a batch table, then ``transform`` the ``readStream``.
There is no stateful operator in the source pipeline, so nothing here
keeps state across micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def apply_transforms(stream: DataFrame, *models) -> DataFrame:
    """Chain fitted models' ``transform`` over a stream (pure projections)."""
    out = stream
    for m in models:
        out = m.transform(out)
    return out


def write_stream(df: DataFrame, path: str, name: str, fmt: str = "parquet", once: bool = True):
    """Append sink; the checkpoint lives in the session's shared checkpoint folder."""
    ckpt = ensure_checkpoint_dir(df.sparkSession).rstrip("/") + f"/stream-{name}"
    w = df.writeStream.format(fmt).option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if once else w
    return w.start(path)

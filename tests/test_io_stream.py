"""Sources/sinks round trip and a fitted transform applied to a stream."""

import os
import tempfile

from pyspark.sql import functions as F

from nullwise.operators import encode as E
from nullwise.operators import impute as I
from nullwise.sources import fixtures as X
from nullwise.sources import io
from nullwise.streaming.apply import apply_transforms, read_stream, write_stream

from .conftest import SMALL


def test_dictionary_rules(spark):
    df = spark.createDataFrame([(1, " Age ", "age in years"), (2, "", "blank"), (3, "Age", "years"),
                                (4, "BMI", "body mass")], "o int, `Variable Name` string, `Explanation` string")
    d = io.dictionary_map(io.load_dictionary(df, "o"))
    assert d == {"Age": "years", "BMI": "body mass"}


def test_split_round_trip_and_csv(spark):
    out = tempfile.mkdtemp(prefix="nullwise-io-", dir="/tmp")
    df = X.pred_bin(spark, SMALL)
    io.write_split(df, os.path.join(out, "s"))
    test = io.read_split(spark, os.path.join(out, "s"), "test")
    assert test.count() == df.where("split = 'test'").count()
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    io.write_results(df.limit(5).withColumn("arr", F.array("score")), os.path.join(out, "r"))
    back = spark.read.option("header", True).csv(os.path.join(out, "r"))
    assert back.count() == 5 and "arr" in back.columns


def test_stream_applies_fitted_plan(spark):
    src = tempfile.mkdtemp(prefix="nullwise-src-", dir="/tmp")
    cases = X.cases_raw(spark, SMALL).select("row_id", "segment", "n_lines")
    cases.write.mode("overwrite").parquet(os.path.join(src, "in"))
    batch = spark.read.parquet(os.path.join(src, "in"))
    plan = E.fit_encoding(batch, ["segment", "n_lines"])
    fill = I.MedianImputer(["n_lines"]).fit(batch)
    stream = read_stream(spark, os.path.join(src, "in"), batch.schema)
    q = write_stream(apply_transforms(stream, plan, fill), os.path.join(src, "out"), "enc-test")
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(src, "out"))
    exp = fill.transform(plan.transform(batch))
    assert got.count() == exp.count()
    assert sorted(got.columns) == sorted(exp.columns)
    assert got.where("n_lines is null").count() == 0

"""Steps of the model queries that were rewritten for large tables give what the plain ones give."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from nullwise.operators import binning
from nullwise.operators import models as L
from nullwise.operators.features import SplineBasis


def test_assembled_splines_are_the_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3)) * [1, 100, 0]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    model = SplineBasis(["a", "b", "c"], 3).fit(rows.where("row_id < 100"))  # the rest goes beyond the ends
    more = rows.unionByName(spark.createDataFrame([(200, float("nan"), 1e9, -1e9)], rows.schema))
    names = [f"{c}_sp{j}" for c in "abc" for j in range(model.n_outputs())]
    want = [list(r)[1:] for r in model.transform(more).select("row_id", *names).orderBy("row_id").collect()]
    got = [r.v for r in model.assembled(more, "s").orderBy("row_id").select(vector_to_array("s").alias("v")).collect()]
    assert got == want
    with pytest.raises(Exception, match="missing cell in b"):
        model.assembled(more.withColumn("b", F.when(F.col("row_id") != 7, F.col("b"))), "s").collect()


def test_many_splines_compile(spark):
    """As column expressions, 40 columns outgrow Spark's generated code; assembled they are one array and one function."""
    cols = [f"c{i}" for i in range(40)]
    rows = spark.range(50).select("id", *[(F.col("id") * (i + 1) % 7).cast("double").alias(c) for i, c in enumerate(cols)])
    model = SplineBasis(cols, 3).fit(rows)
    plan = model.assembled(rows, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "CASE" not in plan
    assert {len(r.v) for r in model.assembled(rows, "s").select(vector_to_array("s").alias("v")).collect()} == {40 * model.n_outputs()}


def test_a_forest_is_the_same_whether_or_not_node_ids_are_kept(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4))
    rows = [(int(r[0] + r[1] ** 2 > 1), [float(v) for v in r]) for r in x]
    train = spark.createDataFrame(rows, "label int, x array<double>").select("label", array_to_vector("x").alias("features")).coalesce(1).persist()
    assert L._ids_fit(train, 10) and not L._ids_fit(train, 10 ** 9)
    trees = []
    for keep in (True, False):
        monkeypatch.setattr(L, "_ids_fit", lambda *_: keep)
        model = L.forest(train, "label", 10).model
        assert model.getOrDefault("cacheNodeIds") == keep
        trees.append(model.toDebugString.partition("\n")[2])
    assert trees[0] == trees[1]


def test_more_tasks_than_cores_fill_whole_waves(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(binning, "ROWS_PER_TASK", 10)
    rows = spark.range(10 * cores + 25)
    assert binning.even_tasks(rows, 10 * cores + 25) == 2 * cores == binning.dealt(rows, 10 * cores + 25).rdd.getNumPartitions()
    assert [binning.even_tasks(rows, n) for n in (0, 10, 11)] == [1, 1, 2 if cores > 1 else 2 * cores]


def test_kernel_components_are_computed_once_for_all_penalties(spark, monkeypatch):
    from nullwise.plans import q_models

    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 2))
    rows = [(i, int(r[0] * r[1] > 0), float(r[0]), float(r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double").persist()
    train, test = df.where("row_id < 150"), df.where("row_id >= 150")
    want = L.sweep(lambda c: L.rbf_classifier(train, "label", ["a", "b"], C=c), [0.1, 10.0], train, test, "label")
    maps, transform = [], L.FourierModel.transform_features
    monkeypatch.setattr(q_models, "prepared", lambda *_: (train, test, ["a", "b"]))
    monkeypatch.setattr(q_models, "KERNEL_C", [0.1, 10.0])
    monkeypatch.setattr(L.FourierModel, "transform_features", lambda self, d: maps.append(d is train) or transform(self, d))
    got = {r["c"]: r["test_accuracy"] for r in q_models.q_sweep_kernel_c(spark, None).collect()}
    assert got == dict(want) and sum(maps) == 1
    assert L.fits_at_once(train, 800, 10 ** 12) == 1 and L.fits_at_once(train, 800, 150) == 4

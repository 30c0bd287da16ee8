"""Imputation, scaling and evaluation properties."""

import numpy as np
from pyspark.sql import functions as F

from nullwise.operators import features as FT
from nullwise.operators import impute as I
from nullwise.operators import metrics as V


def test_median_exact_and_observed_kept(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "row_id int, x double")
    m = I.MedianImputer(["x"]).fit(df)
    assert m.fills["x"] == 2.5  # ml.feature.Imputer's approximate median gives 2.0
    out = {r["row_id"]: r["x"] for r in m.transform(df).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: 3.0, 4: 10.0, 5: 2.5}


def test_standardizer_population(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = FT.Standardizer(["x", "c"]).fit(df).transform(df).collect()
    xs = [r["x"] for r in out]
    assert abs(np.mean(xs)) < 1e-12 and abs(np.std(xs) - 1) < 1e-12
    assert all(r["c"] == 0.0 for r in out)  # zero deviation divides by 1


def test_spline_partition_of_unity_inside(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(0, 10, 21)], "x double")
    m = FT.SplineBasis(["x"]).fit(df)
    rows = m.transform(df, keep_input=True).collect()
    for r in rows:
        # the dropped last basis completes the sum to one
        assert 0 <= r["x_sp0"] + r["x_sp1"] + r["x_sp2"] <= 1 + 1e-12


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_ties_and_negation(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    a = V.auc(df).first()["auc"]
    assert abs(a - _brute_auc(y, s)) < 1e-8
    neg = V.auc(df.withColumn("score", -F.col("score"))).first()["auc"]
    assert abs(a + neg - 1) < 1e-8
    one = V.auc(df.where("label = 1")).first()["auc"]
    assert one is None


def test_confusion_total_and_grid(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    c = V.confusion(df).collect()
    assert len(c) == 9 and sum(r["n"] for r in c) == 4


def test_prf_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "label int, prediction int")
    r = V.prf_binary(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)

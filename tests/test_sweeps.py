"""A sweep answered from one fit equals separate fits.  L12, G16: committees of fitted models."""

import numpy as np
from pyspark.ml.functions import array_to_vector

from nullwise.operators import models as L
from nullwise.plans.q_models import _sweep_table


def frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.7 * rng.standard_normal(n) > 1).astype(int)
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for r, c in zip(x, y)], "label int, x array<double>")
    return df.select("label", array_to_vector("x").alias("features"))


def test_boosting_rounds_from_one_fit(spark):
    train, test = frame(spark, 500, 0), frame(spark, 300, 1)
    values = [1, 4, 10]
    got = L.sweep_boosting_rounds(train, test, "label", values)
    for v, accuracy in got:
        rows = L.boosted(train, "label", v).predict(test).collect()
        assert abs(accuracy - np.mean([r.prediction == r.label for r in rows])) < 1e-12


def test_best_is_the_first_maximum(spark):
    rows = _sweep_table(spark, [(1, 0.5), (2, 0.75), (None, 0.75)], "depth int").collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, False), (2, 0.75, True), (None, 0.75, False)]


def test_soft_vote_and_uncertainty_of_fitted_members(spark):
    train, test = frame(spark, 300, 0), frame(spark, 100, 1).selectExpr("monotonically_increasing_id() as row_id", "*").persist()
    members = [L.tree(train, "label", 2), L.boosted(train, "label", 5), L.logistic(train, "label")]
    probs = [np.array([r.probs for r in m.predict(test).orderBy("row_id").collect()]) for m in members]
    rows = L.SoftVote(members).predict(test).orderBy("row_id").collect()
    assert np.allclose([r.probs for r in rows], np.mean(probs, axis=0), atol=1e-12)
    assert [r.prediction for r in rows] == np.mean(probs, axis=0).argmax(axis=1).tolist()
    unsure = [r.uncertainty for r in L.committee_uncertainty(test, members).orderBy("row_id").collect()]
    assert np.allclose(unsure, 1 - np.mean([p.max(axis=1) for p in probs], axis=0), atol=1e-9)

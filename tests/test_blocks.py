"""Learners on blocks of stored rows: nothing lost between blocks, weights and scores kept, kernel features in tasks."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from nullwise.operators import binning, boosting as B
from nullwise.operators import models as L


def frame(spark, n=500, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 60, (n, 3)) / 4.0
    y = ((x[:, 0] > 7) + (x[:, 1] * x[:, 2] > 50) + (rng.random(n) < 0.2)).astype(int) % k
    rows = [(int(c), [float(v) for v in r]) for r, c in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "label int, features array<double>").repartition(3)


def test_blocks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(binning, "ROWS_PER_TASK", 200)
    x, y, df = frame(spark)
    data = binning.binned(df, "label", "features")
    found = [(*b, c) for batch in data.table.toArrow().to_batches() for bins, ys in binning.blocks(batch, data.p)
             for b, c in zip(bins.tolist(), ys.tolist())]
    assert sorted(found) == sorted((*b, c) for b, c in zip(data.bins.of(x).tolist(), y.tolist()))
    assert data.table.count() < 10  # blocks, not rows
    assert data.table.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("probability", [False, True])
def test_kept_weights_change_no_stump(spark, monkeypatch, probability):
    _, _, df = frame(spark)
    replayed = B.fit_adaboost(df, "label", 12, 0.7, probability).stumps
    written = []
    keep = B._with_weights
    monkeypatch.setattr(B, "KEEP_STUMPS", 5)
    monkeypatch.setattr(B, "_with_weights", lambda *a: written.append(a[-1]) or keep(*a))
    kept = B.fit_adaboost(df, "label", 12, 0.7, probability).stumps
    assert written == [0, 5]  # a scan replays the stumps since then only
    assert [(s.feature, s.cut, s.missing_left) for s in kept] == [(s.feature, s.cut, s.missing_left) for s in replayed]
    assert np.allclose([s.weight for s in kept], [s.weight for s in replayed])


def test_many_leaves_pass_one_byte(spark):
    tree, rng = B.Tree(), np.random.default_rng(1)
    bins = rng.integers(0, 256, (4000, 2)).astype(np.uint8)
    where = np.zeros(len(bins), int)
    for at in range(200):  # node ids beyond 255
        left, right = tree.split(at, at % 2, int(rng.integers(0, 254)), bool(at % 3))
        goes_left = np.where(bins[:, at % 2] == B.MISSING, bool(at % 3), bins[:, at % 2] <= tree.cut[at])
        where = np.where(where == at, np.where(goes_left, left, right), where)
    assert (tree.leaf_of(bins) == where).all()


def test_kernel_features(spark):
    x, _, df = frame(spark, 60)
    wide = df.selectExpr("label", *[f"features[{i}] as c{i}" for i in range(3)])
    fitted = L.rbf_classifier(wide, "label", ["c0", "c1", "c2"])
    rows = fitted.transform_features(wide).select("c0", "c1", "c2", vector_to_array("_rff").alias("z")).collect()
    got, given = np.array([r.z for r in rows]), np.array([[r.c0, r.c1, r.c2] for r in rows])
    assert np.allclose(got, math.sqrt(2 / 100) * np.cos(given @ fitted.weights + fitted.offsets), atol=1e-12)
    assert math.isclose(L.kernel_scale(wide, ["c0", "c1", "c2"]), 1 / (3 * x.var(axis=0).mean()))
    same = L.rbf_classifier(wide, "label", ["c0", "c1", "c2"], gamma=1 / (3 * x.var(axis=0).mean()), n=60)
    assert np.allclose(same.inner.model.coefficientMatrix.toArray(), fitted.inner.model.coefficientMatrix.toArray(), atol=1e-6)

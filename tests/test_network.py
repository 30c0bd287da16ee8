"""The network against a plain one, on one partition and on several."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from nullwise.operators import models as L
from nullwise.operators import network as N


def made(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    return x, ((x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)).astype(int)  # not linear


def frame(spark, x, y, parts):
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "row_id long, label int, x array<double>")
    return df.select("row_id", "label", array_to_vector("x").alias("features")).coalesce(1).orderBy("row_id").repartition(parts) if parts > 1 else \
        df.coalesce(1).sortWithinPartitions("row_id").select("row_id", "label", array_to_vector("x").alias("features"))


def test_gradients_equal_differences():
    x, y = made(20)
    weights = N.initial_weights([3, 5, 4, 3], 1)

    def loss(w):
        z = N.hidden(x, w)[-1] @ w[-2] + w[-1]
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(20), y]).mean()

    for k, g in enumerate(N.gradients(x, y, weights)):
        for at in list(np.ndindex(g.shape))[::3]:
            up, down = ([w.copy() for w in weights] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_one_partition_is_plain_training(spark):
    x, y = made()
    got = N.fit_network(frame(spark, x, y, 1), "label", 3, 3, (8, 8), epochs=4)
    weights = N.initial_weights([3, 8, 8, 3], 42)
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(4):
        order = N.epoch_order(len(x), 42, epoch, 0, 0)
        for at in range(0, len(x), 32):
            rows = order[at:at + 32]
            t += 1
            for k, g in enumerate(N.gradients(x[rows], y[rows], weights)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 1e-3 * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    for a, b in zip(got, weights):
        assert np.allclose(a, b, atol=1e-12)


def test_several_partitions_learn_what_is_not_linear(spark):
    x, y = made(3000)
    df = frame(spark, x, y, 4)
    model = L.neural_forest(df, "label", 3, 20, hidden=(16, 16))
    t, ty = made(600, seed=9)
    right = model.predict(frame(spark, t, ty, 2)).selectExpr("avg(cast(prediction = label as double)) as a").first()["a"]
    assert right > 0.9 > 0.6 > np.bincount(ty).max() / len(ty)


def test_no_rows_keep_the_initial_weights(spark):
    df = frame(spark, *made(5), 1).where("row_id < 0")
    assert np.allclose(N.fit_network(df, "label", 3, 3, (4, 4))[0], N.initial_weights([3, 4, 4, 3], 42)[0])

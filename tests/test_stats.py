"""Pairwise correlations in one scan against NumPy, far from zero and with few common rows."""

import numpy as np

from nullwise.functions.stats import Moments, corr_long


def test_equals_numpy_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 6)) * [1, 10, 1e-3, 1, 1, 1] + [0, 1e9, 5, -3, 1e6, 0]
    x[:, 3] += x[:, 0]
    x[:, 5] = 7.7  # constant
    gone = rng.random(x.shape) < 0.3
    gone[:, 4] = np.arange(500) % 250 > 0  # two values: common rows are few
    x[gone] = np.nan
    cols = list("abcdef")
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(7)
    pairs = [((a, b), a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    got = {(r.p, r.q): r.value for r in corr_long(df, pairs, ["p", "q"]).collect()}
    for i, a in enumerate(cols):
        for j, b in list(enumerate(cols))[i + 1:]:
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            if len(u) < 2 or u.std() < 1e-9 * abs(u.mean()) or v.std() < 1e-9 * abs(v.mean()):
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(u, v)[0, 1]) < 1e-7
    assert all(r.value is None for r in corr_long(df.where("a > 1e9"), pairs, ["p", "q"]).collect())


def test_moments_add_up_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 4)) + 1e6
    x[rng.random(x.shape) < 0.4] = np.nan
    whole = Moments.of(x).correlations()
    parts = [Moments.of(b) for b in np.split(x, 9)]
    assert np.allclose(sum(parts[1:], parts[0]).correlations(), whole, atol=1e-9)
    assert np.allclose(sum(parts[:-1][::-1], parts[-1]).correlations(), whole, atol=1e-9)


def test_constant_where_both_are_there():
    x = np.array([[1.0, np.nan], [0.0, 3.0], [0.0, 5.0], [1.0, np.nan], [0.0, 9.0]] * 40)
    for size in (1, 7, 200):
        parts = [Moments.of(b) for b in np.split(x, range(size, len(x), size))]
        assert np.isnan(sum(parts[1:], parts[0]).correlations()[0, 1])

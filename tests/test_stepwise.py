"""X1-X3 against a plain greedy search that fits every model by itself."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from nullwise.functions.partials import added_up, partial_sums
from nullwise.operators import stepwise as sw


def plain_fit(x, y, k, c=1.0):
    """Newton's method for one L2 soft-max (one sigmoid for two classes) model with a free intercept."""
    z = np.c_[np.ones(len(x)), x]
    penalty = np.r_[0.0, np.full(x.shape[1], 1 / c)]
    if k == 2:
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        return lambda v: (np.c_[np.ones(len(v)), v] @ w > 0).astype(int)
    w = np.zeros((k, z.shape[1]))
    for _ in range(4000):  # plain gradient steps, another way than the one tested
        e = np.exp(z @ w.T)
        p = e / e.sum(axis=1, keepdims=True)
        w -= (((p - (y[:, None] == np.arange(k))).T @ z) + penalty * w) / (0.5 * (z * z).sum(axis=1).max() * len(x) ** 0.5 + 60)
    return lambda v: (np.c_[np.ones(len(v)), v] @ w.T).argmax(axis=1)


def plain_score(x, y, fold, cols, k):
    out = []
    for f in range(fold.max() + 1):
        said = plain_fit(x[fold != f][:, cols], y[fold != f], k)(x[fold == f][:, cols])
        out.append((said == y[fold == f]).mean())
    return np.mean(out)


def plain_forward(x, y, fold, k, n):
    chosen = []
    while len(chosen) < n:
        rest = [j for j in range(x.shape[1]) if j not in chosen]
        chosen.append(rest[int(np.argmax([plain_score(x, y, fold, [*chosen, j], k) for j in rest]))])
    return chosen


def plain_backward(x, y, fold, k, chosen, n):
    chosen = list(chosen)
    while len(chosen) > n:
        chosen.pop(int(np.argmax([plain_score(x, y, fold, chosen[:a] + chosen[a + 1:], k) for a in range(len(chosen))])))
    return chosen


def made(k, n=700, p=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p))
    x[:, 3] = x[:, 0] + 0.3 * rng.standard_normal(n)
    x[:, 7] = 1.0  # says nothing
    score = np.c_[2 * x[:, 0] - x[:, 5], 1.5 * x[:, 2] + x[:, 9], -x[:, 0]][:, :k] + 0.8 * rng.standard_normal((n, k))
    return x, score.argmax(axis=1), rng.integers(0, 5, n)


def frame(spark, x, y, fold):
    df = spark.createDataFrame([([float(c) for c in r], int(a), int(f)) for r, a, f in zip(x, y, fold)], "x array<double>, label int, fold int")
    return df.select("label", "fold", array_to_vector("x").alias("features")).repartition(3)


def test_two_classes_equal_the_plain_search(spark):
    x, y, fold = made(2)
    names = [f"f{j}" for j in range(12)]
    df = frame(spark, x, y, fold)
    up = plain_forward(x, y, fold, 2, 6)
    assert sw.forward_select(df, "label", names) == [names[j] for j in up]
    assert sw.backward_select(df, "label", names, n=8) == [names[j] for j in plain_backward(x, y, fold, 2, range(12), 8)]
    assert sw.forward_backward(df, "label", names) == [names[j] for j in plain_backward(x, y, fold, 2, up, 5)]


def test_three_classes_fit_the_same_optimum(spark):
    x, y, fold = made(3)
    rows = sw.selection_rows(frame(spark, x, y, fold), "label", "fold")
    sets = [(0, 5), (2, 9), (0, 2, 5, 9)]
    w = sw.fit_many(rows, [(s, f) for s in sets for f in (-1, 2)])
    for (s, f), wi in zip([(s, f) for s in sets for f in (-1, 2)], w):
        z, t = np.c_[np.ones((fold != f).sum()), x[fold != f][:, list(s)]], y[fold != f]
        e = np.exp(z @ wi.T)
        gradient = ((e / e.sum(axis=1, keepdims=True)) - (t[:, None] == np.arange(3))).T @ z + np.r_[0.0, np.ones(len(s))] * wi
        assert np.abs(gradient).max() < 1e-3
    scores, _ = sw.cv_scores(rows, sets)
    assert scores == pytest.approx([plain_score(x, y, fold, list(s), 3) for s in sets], abs=0.006)


def test_given_rows_equal_the_plain_search(spark):
    from nullwise.operators import split as T
    from nullwise.plans.q_models import prepared
    train, _, names = prepared(spark, "/root/testdata/sf0.001")
    folded = T.assign_folds(train.select("row_id", "label", "features"), "label", 5, 42).persist()
    rows = folded.select("features", "label", "fold").collect()
    x = np.array([r.features.toArray() for r in rows])
    y, fold = (np.array([r[c] for r in rows]) for c in ("label", "fold"))
    assert sw.forward_select(folded, "label", names) == [names[j] for j in plain_forward(x, y, fold, 2, min(15, len(names) // 2))]
    kept = plain_backward(x, y, fold, 2, range(len(names)), max(5, len(names) // 2))
    assert sw.backward_select(folded, "label", names) == [names[j] for j in kept]


def test_partial_results_are_added_in_groups(spark):
    rows = spark.range(1000, numPartitions=50)
    total = added_up(partial_sums(rows, lambda b: (b.num_rows, b.column(0).to_numpy().sum())), fan=3)
    assert total == (1000, 499500)
    assert added_up(partial_sums(rows.where("id < 0"), lambda b: (b.num_rows,))) is None


def test_sums_of_all_models_at_once_equal_each_model_by_itself(spark):
    for k, finite in ((2, True), (2, False), (3, True), (3, False)):
        x, y, fold = made(k, n=300, p=12, seed=4)
        outputs = 1 if k == 2 else k
        rng = np.random.default_rng(1)
        sets = [(5, 0), (2, 8, 1), (2, 8, 1), tuple(range(12)), ()]
        columns = [np.array([0, *(f + 1 for f in s)]) for s in sets]
        left_out = np.array([-1, 0, 3, 2, 1])
        w = [rng.standard_normal((outputs, len(c))) for c in columns]
        z = np.c_[np.ones(len(x)), x]
        groups = sw._groups(columns, finite)
        assert sorted(i for _, places in groups for i in places) == list(range(5))
        assert finite or len(groups) == 4  # cells that are no numbers stay with the models that use them
        for held, places in groups:
            padded = np.zeros((len(places), outputs, len(held)))
            for at, i in enumerate(places):
                padded[at][:, [list(held).index(c) for c in columns[i]]] = w[i]
            loss, gradient, second = sw._sums(np.ascontiguousarray(z.T[held]), y, fold, left_out[places], padded)
            for at, i in enumerate(places):
                inside = fold != left_out[i]
                mine, t = z[inside][:, columns[i]], y[inside]
                score = mine @ w[i].T
                p = 1 / (1 + np.exp(-score)) if k == 2 else np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
                hit = (t[:, None] == np.arange(1, 2)) if k == 2 else (t[:, None] == np.arange(k))
                of_label = np.where(hit, p, 1 - p)[:, 0] if k == 2 else p[hit]
                blocks = [[(mine * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ mine for b in range(outputs)] for a in range(outputs)]
                g, h = sw._of_model(held, columns[i], gradient[at], second[at])
                assert loss[at] == pytest.approx(-np.log(of_label).sum())
                assert g == pytest.approx(((p - hit).T @ mine).ravel(), abs=1e-9)
                assert h == pytest.approx(np.block(blocks), abs=1e-9)


def test_a_scan_takes_a_few_products_for_all_models():
    columns = [np.array([0, *range(1, j), *range(j + 1, 12)]) for j in range(1, 12) for _ in range(5)]
    (held, places), = sw._groups(columns, True)  # one call of _sums a block, not 55
    assert list(held) == list(range(12)) and len(places) == 55


def test_cells_without_a_number_stay_with_the_models_that_use_them(spark):
    x, y, fold = made(2, n=200)
    x[7, 2] = float("inf")
    rows = sw.selection_rows(frame(spark, x, y, fold), "label", "fold")
    assert not rows.finite
    clean = sw.selection_rows(frame(spark, np.where(np.isfinite(x), x, 0.0), y, fold), "label", "fold")
    assert clean.finite
    both = [sw.fit_many(r, [((0, 1), -1), ((0, 3), 1)]) for r in (rows, clean)]
    for a, b in zip(*both):
        assert a == pytest.approx(b)


def test_stored_rows_are_dealt_evenly(spark):
    x, y, fold = made(2, n=800)
    uneven = frame(spark, x, y, fold).coalesce(1)
    rows = sw.selection_rows(uneven, "label", "fold")
    sizes = [sum(1 for _ in part) for part in rows.table.rdd.glom().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 400

import numpy as np
import pytest

from nullwise.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string"


def matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 64):
        a = rng.standard_normal((n, n))
        yield a @ a.T * 10.0 ** rng.integers(-6, 7)
    yield np.eye(12) * 5  # one eigenvalue
    yield np.diag(np.arange(20.0))  # already diagonal
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    yield (q * np.r_[np.full(10, 7.0), 7.0 + np.arange(10) * 1e-9, np.linspace(1, 2, 20)]) @ q.T  # clusters
    yield np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))  # repeated ones, split matrix
    yield np.ones((9, 9))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_leading_components_equal_numpy(a):
    a = (a + a.T) / 2
    k = min(32, len(a))
    values, vectors = wh.leading_components(a, k)
    scale = np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * scale * len(a))
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-11)
    assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-12 * scale * len(a))


def test_sturm_counts():
    a = np.diag([1.0, 2.0, 3.0]) + np.diag([0.5, 0.0], 1) + np.diag([0.5, 0.0], -1)
    ev = np.linalg.eigvalsh(a)
    assert wh.count_below(np.diag(a), np.diag(a, 1), np.array([ev[0] - 1e-9, ev[1] - 1e-9, ev[1] + 1e-9, 10])).tolist() == [0, 1, 2, 3]


def brute(vectors):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), e, centred @ u / np.sqrt(e), e / np.trace(v)


def frame(spark, vectors, ids):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, "x") for i, v in zip(ids, vectors)], SCHEMA)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((500, 40)) @ np.diag(np.linspace(1, 4, 40))).astype(np.float32)
    v[100:130] = v[0]
    got = wh.whiten(frame(spark, v, range(500)).repartition(40)).collect()
    n, deviation, e, w, share = brute(v)
    assert len(got) == 500 * 32 and got[0].identity_error < 1e-9
    table = np.zeros((500, 32))
    for r in got:
        assert r.n == n and int(r.deviation) == deviation[r.vec_id]
        assert abs(r.explained - share[r.component - 1]) < 1e-12
        table[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((table * w[:, :32]).sum(axis=0))
    assert np.allclose(table, w[:, :32] * sign, atol=1e-9)


def test_unusable_vectors_and_few_dimensions(spark):
    rows = [(i, [float(i % 5), float(i % 3)], 1, "x") for i in range(30)]
    bad = [(100, None, 1, "x"), (101, [1.0, None], 1, "x"), (102, [float("nan"), 0.0], 1, "x"), (103, [float("inf"), 0.0], 1, "x"),
           (104, [1.0, 2.0, 3.0], 1, "x"), (105, [], 1, "x")]
    got = wh.whiten(spark.createDataFrame(rows + bad + [(None, [1.0, 1.0], None, None), rows[0]], SCHEMA)).collect()
    assert len(got) == 32 * 2 and {r.n for r in got} == {32}
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(30))
    assert abs(sum(r.explained for r in got) - 32) < 1e-9 and max(r.identity_error for r in got) < 1e-12


def test_no_spread_and_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 1, "x") for i in range(5)], SCHEMA)
    assert wh.whiten(df).count() == 0
    assert wh.whiten(df.where("vec_id > 5")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1, "x") for i in range(5)], SCHEMA)
    assert [r.component for r in wh.whiten(line).collect()] == [1] * 5  # the second has no spread


def test_large_numbers_stay_exact():
    y = np.array([[1 << 40, -3], [5, 1 << 41]])
    assert wh.exact_products(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()
    model = wh.Whitening(1 << 40, 2, np.array([0, 0], dtype=object), np.ones(2), np.eye(2), 2.0)
    assert model.scaled_deviations(y).tolist() == (y.astype(object) * (1 << 40)).tolist()

import numpy as np

from nullwise.llm.hnsw import Graph, embedding_dedup, matches, unit


def planted(seed=0, n=600, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = [base[i] + 0.05 * rng.standard_normal(d) for i in range(60)]
    chain = [base[70]]
    for _ in range(12):  # each links with the next, not with all
        chain.append(chain[-1] + 0.2 * np.linalg.norm(chain[-1]) / d**0.5 * rng.standard_normal(d))
    group = [base[80] + 0.02 * rng.standard_normal(d) for _ in range(150)]
    return np.concatenate([base, near, chain, group, base[:5], base[:5] * 2]).astype(np.float32)


def brute(vectors, ids):
    u = unit(vectors)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return link.sum(axis=1), label
        label = least


def test_matches_brute_force(spark):
    v = planted()
    ids = np.random.default_rng(1).permutation(len(v)).astype(np.int64)
    rows = [(int(i), [float(x) for x in r], 0) for i, r in zip(ids, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup(df, shard=400).collect()}
    links, label = brute(v, ids)
    exact = [(got[int(i)].n_links == n) for i, n in zip(ids, links)]
    assert np.mean(exact) > 0.98
    assert np.mean([got[int(i)].component_id == c for i, c in zip(ids, label)]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[int(i)].n_links <= n for i, n in zip(ids, links))  # never a link below the bound


def test_recall_on_a_random_sphere():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    v[2000:2400] = v[:400] + 0.2 * rng.standard_normal((400, 64))
    exact = unit(v)
    q, node = matches(Graph(exact.astype(np.float32)), exact, exact)
    truth = exact @ exact.T >= 0.95
    assert len(set(zip(q.tolist(), node.tolist()))) == len(q)
    assert truth[q, node].all() and len(q) >= 0.98 * truth.sum()


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, []), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, schema)).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), *[(i, 0, i, True) for i in range(3, 11)], (11, 3, 1, False), (11, 3, 1, False), (None, 0, None, True)]

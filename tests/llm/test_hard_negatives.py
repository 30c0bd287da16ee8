import numpy as np
from pyspark.sql import functions as F

from nullwise.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def brute(rows, is_anchor, positives=5, negatives=5, least=80):
    rows = sorted({(i, l, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v, l in rows})
    x = np.array([r[2] for r in rows], np.int64)
    out = []
    for i, l, v in rows:
        if not is_anchor(i):
            continue
        s = (x @ np.array(v, np.int64)).tolist()
        other = sorted((-s[k], r[0], r[1]) for k, r in enumerate(rows) if r[0] != i)
        for p, pid, _ in [o for o in other if o[2] == l][:positives]:
            fits = [o for o in other if o[2] != l and least * -p <= 100 * -o[0] <= 100 * -p]
            out += [(i, pid, k + 1, o[1], -p, -o[0]) for k, o in enumerate(fits[:negatives])]
    return sorted(out)


def clustered(n, d, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    v = centres[rng.integers(0, 8, n)] * rng.uniform(0.5, 1.5, (n, 1)) + spread * rng.standard_normal((n, d))
    return [(int(i), [float(c) for c in np.float32(r)], int(l)) for i, r, l in zip(rng.permutation(n), v, rng.integers(0, 3, n))]


def mined(spark, rows, monkeypatch=None, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("id") % 10 == 0, **options).collect())


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rows = clustered(1200, 8, 1)
    assert mined(spark, rows, shard_rows=150, sample_rows=64) == brute(rows, lambda i: i % 10 == 0)


def test_copies_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(hn, "STEP", 32)
    rows = clustered(300, 4, 2)
    rows += [(1000 + i, [1.0, 0.5, 0.25, 0.0], i % 3) for i in range(300)]  # one vector, half of all rows
    rows += rows[:40]  # repeated rows
    assert mined(spark, rows, shard_rows=100, sample_rows=32) == brute(rows, lambda i: i % 10 == 0)


def test_small_sample_one_shard_few_positives(spark):
    rows = clustered(60, 3, 3) + [(500, [0.0, 0.0, 0.0], 9), (510, [-1.0, -1.0, -1.0], 8), (511, [1.0, 1.0, 1.0], 8)]
    assert mined(spark, rows, sample_rows=3) == brute(rows, lambda i: i % 10 == 0)


def test_unusable_rows_and_empty_table(spark):
    rows = clustered(200, 3, 4)
    bad = [(2000, None, 1), (2010, [1.0, None, 0.0], 1), (2020, [float("nan")] * 3, 1), (2030, [1.0, 0.0, float("inf")], 1),
           (2040, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (2050, [9.0, 9.0], 1), (2060, [], 1)]
    assert mined(spark, rows + bad) == brute(rows, lambda i: i % 10 == 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty, F.col("id") % 10 == 0).collect() == []


def test_ranges_eliminate_subtrees_on_clustered_rows():
    rows = clustered(20_000, 16, 5, spread=0.05)
    ids, x, labels = (np.array([r[k] for r in rows]) for k in range(3))
    x = np.floor(256 * x).astype(np.int64)
    space = hn.Space(int((x * x).sum(axis=1).max()))
    tree = hn.Tree(ids, labels, x, space)
    points = space.lifted(x[:1])
    d = hn.distances(space.lifted(x), points)
    q = np.arange(100)
    none = np.full(100, hn._NONE)
    query = {"id": ids[q], "label": labels[q], "x": x[q], "low": none, "high": none}
    best, scored = hn.search(tree, space, (points, d.min(axis=0), d.max(axis=0)), query, True, 5)
    s = np.where((labels[q][:, None] == labels[None, :]) & (ids[q][:, None] != ids[None, :]), x[q] @ x.T, hn._NONE + 1)
    assert (best.score == -np.sort(-s, axis=1)[:, :5]).all()
    assert scored < 0.5 * 100 * len(rows)


def test_scores_beyond_double_precision():
    a = np.array([[1 << 30, 3], [-5, 1 << 31]])
    assert hn.scores(a, a).tolist() == [[(1 << 60) + 9, (-5 << 30) + (3 << 31)], [(-5 << 30) + (3 << 31), 25 + (1 << 62)]]

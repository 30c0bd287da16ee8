"""Encoding, profiling and splitting on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from nullwise.operators import columns as P
from nullwise.operators import encode as E
from nullwise.operators import missing as M
from nullwise.operators import split as T

SCHEMA = "row_id long, num double, empty double, one string, three string, bin string, y string"
ROWS = [
    (1, 1.0, None, "a", "x", "no", "p"), (2, None, None, "a", None, "yes", "q"),
    (3, 3.0, None, None, "z", None, "p"), (4, 4.0, None, "a", "y", "no", None),
]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_profile_and_all_null(frame):
    prof = {r["feature"]: (r["n_missing"], r["pct_missing"]) for r in M.missing_profile(frame).collect()}
    assert prof["empty"] == (4, 100.0) and prof["num"] == (1, 25.0)
    assert "empty" not in P.drop_all_null(frame).columns
    tot = M.missing_total(frame, ["num", "one"]).first()
    assert (tot["n_cells"], tot["n_missing"]) == (8, 2)


def test_encoding_kinds_and_nulls(frame):
    cols = ["num", "empty", "one", "three", "bin"]
    plan = E.fit_encoding(frame, cols)
    kinds = {c.name: c.kind for c in plan.columns}
    assert kinds == {"num": "numeric", "empty": "dropped", "one": "onehot",
                     "three": "onehot", "bin": "binary"}
    out = {r["row_id"]: r for r in plan.transform(frame).collect()}
    assert out[1]["bin"] == 0.0 and out[2]["bin"] == 1.0 and out[3]["bin"] is None
    assert out[2]["three_x"] is None and out[2]["three_z"] is None  # null -> null in all dummies
    assert out[1]["three_x"] == 1.0 and out[1]["three_y"] == 0.0
    assert out[3]["one_a"] is None and out[1]["one_a"] == 1.0
    assert "empty" not in plan.feature_names()


def test_too_many_categories(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(E.TooManyCategories):
        E.distinct_values(df, ["s"], cap=10)


def test_targets_and_inverse(frame, spark):
    enc = E.fit_targets(frame, ["y"])
    assert enc.classes["y"] == ["p", "q"]
    codes = {r["row_id"]: r["y"] for r in enc.transform(frame).collect()}
    assert codes == {1: 0, 2: 1, 3: 0, 4: None}
    lm = E.label_map(frame, ["y"])
    back = E.id_to_label(spark.createDataFrame([(0,), (7,)], "code int"), lm, "y", "code").collect()
    assert {r["code"]: r["label_name"] for r in back} == {0: "p", 7: "class_7"}


def test_split_quotas_exact_and_order_free(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("row_id"),
                                     F.when(F.col("id") % 10 < 3, "a").otherwise("b").alias("y"))
    s1 = T.stratified_split(df, "y", 0.2, 42)
    s2 = T.stratified_split(df.repartition(7).orderBy(F.rand(3)), "y", 0.2, 42)
    a = {r["row_id"]: r["split"] for r in s1.collect()}
    b = {r["row_id"]: r["split"] for r in s2.collect()}
    assert a == b and len(a) == 1000
    tests = [r for r, s in a.items() if s == "test"]
    assert len(tests) == 200
    assert sum(1 for r in tests if r % 10 < 3) == 60


def test_rare_classes_and_compaction(spark):
    tr = spark.createDataFrame([(i, "a") for i in range(4)] + [(10 + i, "b") for i in range(5)]
                               + [(20 + i, "c") for i in range(6)], "row_id int, y string")
    te = spark.createDataFrame([(100, "a"), (101, "b"), (102, "c"), (103, "d")], "row_id int, y string")
    a, b = T.drop_rare_classes(tr, te, "y", 5, "label")
    assert sorted({r["label"] for r in a.collect()}) == [0, 1]
    assert {r["row_id"]: r["label"] for r in b.collect()} == {101: 0, 102: 1}


def test_folds_balanced(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"))
    f = T.assign_folds(df, "y", 5).groupBy("fold", "y").count().collect()
    assert all(r["count"] == 10 for r in f)


def test_more_than_a_thousand_categories(spark):
    from pyspark.sql import functions as F

    from nullwise.operators import encode as E
    df = spark.range(1001).select(F.col("id").alias("row_id"), F.format_string("v%04d", "id").alias("c"))
    plan = E.fit_encoding(df, ["c"])
    assert len(plan.feature_names()) == 1001
    codes = E.fit_targets(df, ["c"]).transform(df).where("row_id in (0, 1000)").orderBy("row_id").collect()
    assert [r.c for r in codes] == [0, 1000]

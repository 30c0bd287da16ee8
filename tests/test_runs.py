"""Run metrics on more than two classes, profiles of empty tables, example slots of the prompt classifier."""

import pytest
from pyspark.sql import functions as F

from nullwise.operators import metrics as V
from nullwise.operators import missing as M
from nullwise.operators.classifier import PromptClassifier, _prototype_cases
from nullwise.plans import q_scoring
from nullwise.sources import fixtures

RUN = "model string, split string, label int, prediction int, p0 double, p1 double, p2 double"


def _values(df):
    return {(r["split"], r["metric"]): r["value"] for r in df.collect()}


def test_three_classes_are_weighted(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 0)]
    rows = [("m", "test", y, p, *[0.8 if c == y else 0.1 for c in range(3)]) for y, p in pairs]
    out = _values(V.run_metrics(spark.createDataFrame(rows, RUN), ["model"], prob_cols=["p0", "p1", "p2"]))
    assert out["test", "precision"] == pytest.approx((0.5 + 2 / 3 + 1) / 3, abs=1e-8)
    assert out["test", "recall"] == pytest.approx(2 / 3, abs=1e-8)
    assert out["test", "f1"] == pytest.approx((0.5 + 0.8 + 2 / 3) / 3, abs=1e-8)
    assert out["test", "auc"] == 1.0


def test_test_split_decides_for_all_splits(spark):
    rows = [("m", "test", y, y, 1.0 - y, float(y), 0.0) for y in (0, 1, 1)]
    rows += [("m", "train", y, 1, 0.2, 0.8, 0.0) for y in (0, 1, 2)]
    out = _values(V.run_metrics(spark.createDataFrame(rows, RUN).withColumnRenamed("p1", "score"), ["model"]))
    assert out["test", "auc"] == 1.0 and out["test", "precision"] == 1.0
    assert out["train", "precision"] == pytest.approx(1 / 3, abs=1e-8) and out["train", "recall"] == 1.0


def test_no_rows(spark):
    assert V.run_metrics(spark.createDataFrame([], RUN), ["model"], prob_cols=["p0", "p1", "p2"]).count() == 0
    out = M.missing_profile(spark.createDataFrame([], "`it's` int, b string")).collect()
    assert [(r["feature"], r["n_missing"], r["pct_missing"]) for r in out] == [("it's", 0, None), ("b", 0, None)]


@pytest.mark.parametrize("policy", ["first", "oldest"])
def test_misses_take_slots(spark, policy):
    rows = [(i, float(i), "u" if i % 2 else "v", 0 if i < 10 else 1) for i in range(20)]
    train = spark.createDataFrame(rows, "row_id int, x double, s string, label int")
    clf = PromptClassifier(lambda prompts: ["0"] * len(prompts), ["x", "s"], "t", {0: "no", 1: "yes"},
                           shots=2, max_total=4, refine_rounds=0, policy=policy).fit(train)
    first = dict(clf.slots)
    assert set(first) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert clf._refresh(train, 0)  # ten rows of class 1 are missed
    assert clf.arrivals == {0: 2, 1: 12}
    changed = {k for k in clf.slots if clf.slots[k] != first[k]}
    assert changed == ({(1, 1)} if policy == "first" else {(1, 1), (1, 2)})
    prompt = clf.prompts(train.where("row_id = 3")).first()["prompt"]
    assert "0 = no\n1 = yes" in prompt and prompt.count("Correct label for t: 1 (yes)") == 2
    assert prompt.rstrip().endswith("no explanation.") and "x = 3.0; s = u" in prompt


def _rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.col("id").cast("double").alias("total_price"), *[F.col("id").cast("double").alias(c) for c in ("acct_bal", "n_lines", "sum_qty", "avg_disc")],
        F.lit("s").alias("segment"), F.lit("F").alias("line_status"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("target_bin"),
        F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("target_multi"))


def test_labelled_split_is_computed_once(spark, monkeypatch):
    """Later scans read the written split, in as many parts as its rows need."""
    monkeypatch.setattr(fixtures, "cases_raw", lambda spark, sf: _rows(spark, 120_000))
    out = q_scoring._labelled(spark, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "FileScan parquet" in plan
    assert len(out.inputFiles()) == 3
    split = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert split == {(0, "train"): 48_000, (0, "test"): 12_000, (1, "train"): 48_000, (1, "test"): 12_000}


def test_prototype_texts_leave_the_rows_in_place(spark):
    """The few nearest rows are broadcast whatever Spark's threshold, so train is not shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train = spark.createDataFrame([(i, float(i), i // 10) for i in range(20)], "row_id int, x double, label int")
        out = _prototype_cases(train, "label", ["x"], 2, "row_id", {}, [F.col("x").alias("_x")])
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["label"], r["rank"], r["case_text"], r["_x"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    assert rows == [(0, 1, "x = 4.0", 4.0), (0, 2, "x = 5.0", 5.0), (1, 1, "x = 14.0", 14.0), (1, 2, "x = 15.0", 15.0)]

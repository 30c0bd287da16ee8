"""Evaluation (V1-V10) over prediction tables.

A prediction table has ``label``, ``prediction`` and optionally a score or
per-class probability columns, plus any grouping columns (run, split...).
Every metric is a grouped aggregate (partial aggregation, no row reaches
the driver).  ROC curves and AUC aggregate to one row per distinct score
first; the cumulative counts then come from ``descending_prefix_sums``,
which never puts a whole curve in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import descending_prefix_sums

DIGITS = 8


def _r(c):
    return F.round(c, DIGITS)


def accuracy(pred: DataFrame, groups=(), label="label", prediction="prediction") -> DataFrame:
    """V1: (groups..., n, accuracy, error_rate)."""
    ok = (F.col(label) == F.col(prediction)).cast("double")
    return pred.groupBy(*groups).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                     _r(F.avg(ok)).alias("accuracy"),
                                     _r(1 - F.avg(ok)).alias("error_rate"))


def prf_binary(pred: DataFrame, groups=(), label="label", prediction="prediction",
               positive=1) -> DataFrame:
    """V2 binary: precision, recall, F1 of the positive class; 0 when undefined."""
    tp = F.sum(((F.col(label) == positive) & (F.col(prediction) == positive)).cast("long"))
    pp = F.sum((F.col(prediction) == positive).cast("long"))
    ap = F.sum((F.col(label) == positive).cast("long"))
    a = pred.groupBy(*groups).agg(tp.alias("_tp"), pp.alias("_pp"), ap.alias("_ap"))
    prec = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_pp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_ap")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_tp"), F.col("_pp") + F.col("_ap")), F.lit(0.0))
    return a.select(*groups, _r(prec).alias("precision"), _r(rec).alias("recall"), _r(f1).alias("f1"))


def per_class_counts(pred: DataFrame, groups=(), label="label", prediction="prediction") -> DataFrame:
    """(groups..., class, tp, n_pred, n_true) over the union of observed labels."""
    g = list(groups)
    both = pred.select(*g, F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("is_true"),
                 (F.col(label) == F.col(prediction)).cast("int").alias("hit")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).alias("is_true"), F.lit(0).alias("hit")),
    )).alias("x")).select(*g, "x.*")
    return both.groupBy(*g, "class").agg(
        F.sum("hit").cast("long").alias("tp"),
        F.sum(1 - F.col("is_true")).cast("long").alias("n_pred"),
        F.sum("is_true").cast("long").alias("n_true"))


def prf_weighted(pred: DataFrame, groups=(), label="label", prediction="prediction") -> DataFrame:
    """V2 weighted: per-class precision/recall/F1 averaged with true-class support."""
    c = per_class_counts(pred, groups, label, prediction)
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_true")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_pred") + F.col("n_true")), F.lit(0.0))
    w = F.col("n_true")
    return c.groupBy(*groups).agg(
        _r(F.sum(p * w) / F.sum(w)).alias("precision"),
        _r(F.sum(r * w) / F.sum(w)).alias("recall"),
        _r(F.sum(f * w) / F.sum(w)).alias("f1"))


def prf(pred: DataFrame, groups=(), label="label", prediction="prediction") -> DataFrame:
    """V2 rule of the source: binary for class 1 when a group has two classes, else weighted."""
    b = prf_binary(pred, groups, label, prediction)
    w = prf_weighted(pred, groups, label, prediction)
    k = pred.groupBy(*groups).agg(F.count_distinct(label).alias("_k"))
    g = list(groups)
    if not g:  # one row each: join on a constant key instead of a cartesian product
        k, b, w = (d.withColumn("_all", F.lit(0)) for d in (k, b, w))
        j = k.join(b.alias("b"), "_all").join(w.alias("w"), "_all")
    else:
        j = k.join(b.alias("b"), g).join(w.alias("w"), g)
    pick = lambda m: F.when(F.col("_k") == 2, F.col(f"b.{m}")).otherwise(F.col(f"w.{m}")).alias(m)
    return j.select(*g, pick("precision"), pick("recall"), pick("f1"))


def confusion(pred: DataFrame, groups=(), label="label", prediction="prediction") -> DataFrame:
    """V3: counts on the full grid of observed labels (zeros included)."""
    g = list(groups)
    counts = pred.groupBy(*g, label, prediction).agg(F.count(F.lit(1)).cast("long").alias("n"))
    classes = pred.select(*g, F.explode(F.array(label, prediction)).alias("c")) \
                  .groupBy(*g).agg(F.sort_array(F.collect_set("c")).alias("_cl"))
    grid = (classes.select(*g, F.explode("_cl").alias(label), "_cl")
            .select(*g, label, F.explode("_cl").alias(prediction)))
    return (grid.join(counts, g + [label, prediction], "left")
            .select(*g, label, prediction, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _score_counts(pred: DataFrame, groups, label, score, positive=1) -> DataFrame:
    pos = (F.col(label) == positive).cast("long")
    return pred.groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def roc_points(pred: DataFrame, groups=(), label="label", score="score", positive=1) -> DataFrame:
    """V4: one ROC point per distinct score (threshold), tie-aware, no point dropped."""
    g = list(groups)
    c = _score_counts(pred, g, label, score, positive)
    s = descending_prefix_sums(c, g, "threshold", ["pos", "neg"])
    tot = c.groupBy(*g).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    if g:
        j = s.join(tot, g)  # one row per group on the right
    else:
        j = s.withColumn("_all", F.lit(0)).join(F.broadcast(tot.withColumn("_all", F.lit(0))), "_all").drop("_all")
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return j.select(*g, "threshold", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                    _r(F.try_divide(tp.cast("double"), F.col("_P"))).alias("tpr"),
                    _r(F.try_divide(fp.cast("double"), F.col("_N"))).alias("fpr"))


def auc(pred: DataFrame, groups=(), label="label", score="score", positive=1) -> DataFrame:
    """V5: area under ROC with ties counted half (trapezoid over V4's points).

    NULL when a group has only one class.
    """
    g = list(groups)
    c = _score_counts(pred, g, label, score, positive)
    s = descending_prefix_sums(c, g, "threshold", ["pos"])
    a = s.groupBy(*g).agg(
        F.sum(F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos"))).alias("_u"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return a.select(*g, _r(F.try_divide(F.col("_u"), F.col("_P") * F.col("_N"))).alias("auc"))


def _one_vs_rest(pred: DataFrame, groups, label, prob_cols) -> DataFrame:
    g = list(groups)
    return (pred.select(*g, F.col(label).alias("_y"), F.posexplode(F.array(*prob_cols)).alias("class", "score"))
            .withColumn("label", (F.col("_y") == F.col("class")).cast("int")).drop("_y"))


def auc_ovr(pred: DataFrame, prob_cols: list[str], groups=(), label="label") -> DataFrame:
    """V6: one-vs-rest AUC per class, averaged with class prevalence; NULL if undefined."""
    g = list(groups)
    long = _one_vs_rest(pred, g, label, prob_cols)
    per = auc(long, g + ["class"], "label", "score")
    prev = long.groupBy(*g, "class").agg(F.sum("label").alias("_n"))
    j = per.join(prev, g + ["class"])
    return j.groupBy(*g).agg(
        _r(F.when(F.count(F.when(F.col("_n") > 0, F.lit(1))) == F.count(F.lit(1)),
                  F.sum(F.col("auc") * F.col("_n")) / F.sum("_n"))).alias("auc_ovr"))


def roc_micro(pred: DataFrame, prob_cols: list[str], groups=(), label="label") -> DataFrame:
    """V7: micro-average ROC: every (row, class) pair is one binary case."""
    long = _one_vs_rest(pred, groups, label, prob_cols)
    return roc_points(long, groups, "label", "score")


def auc_micro(pred: DataFrame, prob_cols: list[str], groups=(), label="label") -> DataFrame:
    long = _one_vs_rest(pred, groups, label, prob_cols)
    return auc(long, groups, "label", "score").withColumnRenamed("auc", "auc_micro")


RUN_KEYS = ["target", "features", "model"]


def run_metrics(pred: DataFrame, keys=RUN_KEYS, split="split", prob_cols=(), label="label",
                prediction="prediction", score="score") -> DataFrame:
    """Long metrics table (A11): keys, split, metric, value for accuracy/precision/recall/f1/auc.

    A run whose test split (all splits, without one) has two classes gets the
    formulas for class 1 and the plain AUC of ``score`` (of the second of
    ``prob_cols`` where there is no score); any other run gets averages
    weighted by class size and the one-vs-rest AUC of ``prob_cols`` (null
    without them).  Rows without a label or prediction are left out.
    Accuracy, precision, recall and F1 come from one grouped count.
    """
    keys, prob_cols = list(keys), list(prob_cols)
    g = keys + [split]
    known = pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    cells = known.groupBy(*g, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    per = (cells.select(*g, F.explode(F.array(
        F.struct(F.col(label).cast("long").alias("class"), F.col("n").alias("n_true"), none.alias("n_pred"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(none).alias("tp")),
        F.struct(F.col(prediction).cast("long").alias("class"), none.alias("n_true"), F.col("n").alias("n_pred"),
                 none.alias("tp")))).alias("x")).select(*g, "x.*")
        .groupBy(*g, "class").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")]))
    hits = F.col("tp").cast("double")
    zero = F.lit(0.0)
    rates = {"precision": F.coalesce(F.try_divide(hits, F.col("n_pred")), zero),
             "recall": F.coalesce(F.try_divide(hits, F.col("n_true")), zero),
             "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_pred") + F.col("n_true")), zero)}
    wide = per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"), F.count_if(F.col("n_true") > 0).alias("_k"),
        *[F.coalesce(F.max(F.when(F.col("class") == 1, r)), zero).alias(f"_one_{m}") for m, r in rates.items()],
        *[(F.sum(r * F.col("n_true")) / F.sum("n_true")).alias(f"_all_{m}") for m, r in rates.items()])
    runs = Window.partitionBy(*keys)  # one row per run and split
    wide = wide.withColumn("_two", F.coalesce(F.max(F.when(F.col(split) == "test", F.col("_k"))).over(runs),
                                              F.max("_k").over(runs)) == 2)
    plain_score = score if score in pred.columns else prob_cols[1] if len(prob_cols) == 2 else None
    areas = {"_one_auc": auc(known, g, label, plain_score) if plain_score else None,
             "_all_auc": auc_ovr(known, prob_cols, g, label) if prob_cols else None}
    for name, area in areas.items():
        if area is None:
            wide = wide.withColumn(name, F.lit(None).cast("double"))
        else:
            wide = wide.join(area.toDF(*g, name), g, "left")
    value = {"accuracy": F.col("accuracy")} | {
        m: F.when(F.col("_two"), F.col(f"_one_{m}")).otherwise(F.col(f"_all_{m}"))
        for m in ("precision", "recall", "f1", "auc")}
    return wide.select(*g, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), _r(v).cast("double").alias("value")) for m, v in value.items()
    ])).alias("x")).select(*g, "x.metric", "x.value")


def overfit_report(metrics: DataFrame, keys=RUN_KEYS, gap: float = 0.1) -> DataFrame:
    """V8: train/test values and differences; overfit when the accuracy gap > ``gap``."""
    out = []
    for m in ("accuracy", "f1", "auc"):
        for s in ("train", "test"):
            out.append(F.max(F.when((F.col("metric") == m) & (F.col("split") == s), F.col("value")))
                       .alias(f"{s}_{m}"))
    w = metrics.groupBy(*keys).agg(*out)
    return w.select(*keys, *[f"{s}_{m}" for m in ("accuracy", "f1", "auc") for s in ("train", "test")],
                    *[_r(F.col(f"train_{m}") - F.col(f"test_{m}")).alias(f"diff_{m}")
                      for m in ("accuracy", "f1", "auc")],
                    (F.col("train_accuracy") - F.col("test_accuracy") > gap).alias("overfit"))


def summary(metrics: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """V9: one wide row per run: <split>_<metric> columns."""
    cols = [F.max(F.when((F.col("metric") == m) & (F.col("split") == s), F.col("value"))).alias(f"{s}_{m}")
            for s in ("train", "test") for m in ("accuracy", "precision", "recall", "f1", "auc")]
    return metrics.groupBy(*keys).agg(*cols)


def selection_impact(metrics: DataFrame, metric: str = "accuracy",
                     full: str = "full", selected: str = "selected") -> DataFrame:
    """Test metric with the selected features minus with all features, per (target, model)."""
    m = metrics.where((F.col("metric") == metric) & (F.col("split") == "test"))
    a = m.where(F.col("features") == full).select("target", "model", F.col("value").alias("full_value"))
    b = m.where(F.col("features") == selected).select("target", "model", F.col("value").alias("selected_value"))
    return (a.join(b, ["target", "model"], "inner")
            .withColumn("difference", _r(F.col("selected_value") - F.col("full_value"))))

"""Exploration aggregates.

Correlations are computed pairwise-complete (rows where either side is null
do not count), all pairs in one scan of matrix products.  Undefined correlations (a constant side)
are dropped.  Quartiles are exact and distributed (``exact_quantiles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles
from ..functions.stats import corr_long

def _defined(col: str):
    return F.col(col).isNotNull() & ~F.isnan(col)


def corr_matrix(df: DataFrame, cols: list[str], digits: int = 8) -> DataFrame:
    """A1: (feature_a, feature_b, corr) for every pair a < b in ``cols`` order."""
    pairs = [((a, b), a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    long = corr_long(df, pairs, ["feature_a", "feature_b"])
    return long.where(_defined("value")).select(
        "feature_a", "feature_b", F.round("value", digits).alias("corr"))


def target_corr(df: DataFrame, features: list[str], targets: list[str], digits: int = 8) -> DataFrame:
    """A2: correlation of every feature with every (numeric) target; undefined rows dropped."""
    pairs = [((f, t), f, t) for f in features for t in targets]
    long = corr_long(df, pairs, ["feature", "target"])
    return long.where(_defined("value")).select(
        "feature", "target", F.round("value", digits).alias("corr"))


def top_corr(corr: DataFrame, k: int = 15) -> DataFrame:
    """A3: top k features per target by |corr|, with the sign.

    Input is A2's output (features x targets rows), so the window is small.
    """
    w = Window.partitionBy("target").orderBy(F.desc(F.abs("corr")), F.asc("feature"))
    return (corr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("sign", F.when(F.col("corr") >= 0, "+").otherwise("-"))
            .select("target", F.col("rank").cast("int").alias("rank"), "feature", "corr", "sign"))


def _long_classes(df: DataFrame, targets: list[str]) -> DataFrame:
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("class")) for t in targets
    ])).alias("x")).select("x.target", "x.class").where(F.col("class").isNotNull()))


def target_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    """A4: (target, class, n) for every target; one partial/final aggregate."""
    return (_long_classes(df, targets).groupBy("target", "class")
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def class_balance(df: DataFrame, targets: list[str], digits: int = 6) -> DataFrame:
    """A5: class share in percent with the code of each class (sorted order)."""
    c = target_counts(df, targets)
    w = Window.partitionBy("target")
    return c.select(
        "target", (F.dense_rank().over(w.orderBy("class")) - 1).cast("int").alias("code"),
        F.col("class").alias("label"), "n",
        F.round(F.col("n") * 100.0 / F.sum("n").over(w), digits).alias("pct"))


def _long_values(df: DataFrame, features: list[str], by: str | None, key: str | None = None) -> DataFrame:
    extra = [F.col(key)] if key else []
    cls = [F.col(by).cast("string").alias("class")] if by else []
    return (df.select(*extra, *cls, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("x")).select(*([key] if key else []), *(["class"] if by else []), "x.feature", "x.value")
        .where(F.col("value").isNotNull()))


def box_stats(df: DataFrame, features: list[str], by: str, digits: int = 8) -> DataFrame:
    """Per (feature, class): quartiles, whiskers (extreme values inside 1.5 IQR), outliers."""
    long = _long_values(df, features, by).where(F.col("class").isNotNull())
    q = exact_quantiles(long, ["feature", "class"], "value", [0.25, 0.5, 0.75])
    quart = q.groupBy("feature", "class").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
        F.max("n").alias("n"))
    fences = quart.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
                  .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per (feature, class): features x classes, bounded by the category cap
    j = long.join(F.broadcast(fences.select("feature", "class", "_lo", "_hi")), ["feature", "class"])
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    wh = j.groupBy("feature", "class").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    out = quart.join(wh, ["feature", "class"])
    r = lambda c: F.round(c, digits)
    return out.select("feature", "class", F.col("n").cast("long").alias("n"),
                      r(F.col("q1")).alias("q1"), r(F.col("median")).alias("median"),
                      r(F.col("q3")).alias("q3"), r(F.col("whisker_low")).alias("whisker_low"),
                      r(F.col("whisker_high")).alias("whisker_high"), "n_outliers")


def box_outliers(df: DataFrame, features: list[str], by: str, key: str = "row_id") -> DataFrame:
    """A6 second part: the rows outside the 1.5 IQR fences."""
    long = _long_values(df, features, by, key).where(F.col("class").isNotNull())
    q = exact_quantiles(long, ["feature", "class"], "value", [0.25, 0.75])
    f = q.groupBy("feature", "class").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("_q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("_q3"))
    f = f.select("feature", "class", (F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
                 (F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
    j = long.join(F.broadcast(f), ["feature", "class"])
    return (j.where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
            .select(key, "feature", "class", "value"))


def binary_rates(df: DataFrame, features: list[str], targets: list[str], digits: int = 6) -> DataFrame:
    """For each 0/1 feature value and 0/1 target: share of rows with target 1 (percent)."""
    rows = []
    for t in targets:
        for f in features:
            rows.append(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                                 F.lit(t).alias("target"), F.col(t).cast("double").alias("y")))
    long = (df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
            .where(F.col("value").isNotNull() & F.col("y").isNotNull()))
    return (long.groupBy("feature", "value", "target")
            .agg(F.count(F.lit(1)).cast("long").alias("n"),
                 F.round(F.avg(F.when(F.col("y") == 1, 100.0).otherwise(0.0)), digits).alias("pct_positive")))


def pair_bins(df: DataFrame, features: list[str], by: str, bins: int = 10) -> DataFrame:
    """Pair-plot data as counts: 2-D bins for pairs a <= b (a == b: the 1-D histogram)."""
    row = df.agg(*[x for i, f in enumerate(features)
                   for x in (F.min(F.col(f).cast("double")).alias(f"_lo{i}"),
                             F.max(F.col(f).cast("double")).alias(f"_hi{i}"))]).first()
    def bin_of(i, f):
        lo, hi = row[f"_lo{i}"], row[f"_hi{i}"]
        if lo is None or hi is None or hi == lo:
            return F.when(F.col(f).isNotNull(), F.lit(0))
        b = F.floor((F.col(f).cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins))
        # least() skips nulls, so a missing value must stay null explicitly
        return F.when(F.col(f).isNotNull(), F.least(b, F.lit(bins - 1)).cast("int"))
    cells = [F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                      bin_of(i, a).alias("bin_x"), bin_of(j, b).alias("bin_y"))
             for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    long = (df.select(F.col(by).cast("string").alias("class"), F.explode(F.array(*cells)).alias("x"))
            .select("class", "x.*").where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull()))
    return (long.groupBy("feature_x", "feature_y", "class", "bin_x", "bin_y")
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def metric_pivot(metrics: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean of one metric, model x (target_features) with an explicit key list."""
    m = (metrics.where((F.col("metric") == metric) & (F.col("split") == "test"))
         .withColumn("_key", F.concat_ws("_", "target", "features")))
    return (m.groupBy("model").pivot("_key", keys).agg(F.round(F.avg("value"), 8)))


def prediction_corr(predictions: DataFrame, models: list[str], key: str = "row_id",
                    digits: int = 8) -> DataFrame:
    """A10: correlation between models' predicted labels, aligned by key.

    The pivot groups by key (a uniform shuffle); models that are absent are skipped,
    and fewer than two present models give an empty result.
    """
    wide = (predictions.groupBy(key).pivot("run", models)
            .agg(F.first("prediction")))
    present = [m for m in models if m in wide.columns]
    return corr_matrix(wide, present, digits).withColumnRenamed("feature_a", "model_a") \
        .withColumnRenamed("feature_b", "model_b")


def union_runs(dfs: list[DataFrame]) -> DataFrame:
    """Rows concatenated across targets / models (by column name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def rank_runs(metrics: DataFrame) -> DataFrame:
    """Test error rate per run, ranked within target (lowest first)."""
    acc = metrics.where((F.col("metric") == "accuracy") & (F.col("split") == "test"))
    w = Window.partitionBy("target").orderBy("error", "features", "model")
    return (acc.select("target", "features", "model", F.round(1 - F.col("value"), 8).alias("error"))
            .withColumn("rank", F.row_number().over(w).cast("int")))


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """Best run per target on the test split; ties go to the first in declared order."""
    m = metrics.where((F.col("metric") == by) & (F.col("split") == "test"))
    w = Window.partitionBy("target").orderBy(F.desc("value"), "features", "model")
    return (m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("target", "features", "model", F.col("value").alias(by)))

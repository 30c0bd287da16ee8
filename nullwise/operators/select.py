"""Feature scoring and selection summaries (X5, X7, X8; model-based X1-X4, X6
live in ``models``).

Mutual information is the plug-in estimate on quantile bins: bin edges
are exact per-feature quantiles (``exact_quantiles``), the joint counts are
one grouped aggregate over the unpivoted table, and the sum
p(b,y) log(p(b,y) / (p(b) p(y))) is another.  The neighbour-based estimator
of the source pipeline is all-pairs and is not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles


def quantile_edges(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, edges array<double>): the interior cut points of ``bins`` bins."""
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("x")).select("x.feature", "x.value"))
    q = exact_quantiles(long, ["feature"], "value", [i / bins for i in range(1, bins)])
    return q.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("edges"))


def mi_rank(df: DataFrame, features: list[str], label: str, bins: int = 10,
            digits: int = 8) -> DataFrame:
    """(feature, mi, rank) in nats; rows with a null feature or label are skipped."""
    lab = df.where(F.col(label).isNotNull())
    edges = quantile_edges(lab, features, bins)
    long = (lab.select(F.col(label).cast("string").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("x")).select("y", "x.feature", "x.value").where(F.col("value").isNotNull()))
    # one row per feature: bounded by the schema
    b = long.join(F.broadcast(edges), "feature").withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    joint = b.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n_by"))
    wf = Window.partitionBy("feature")
    p = (joint.withColumn("n", F.sum("n_by").over(wf))
         .withColumn("n_b", F.sum("n_by").over(Window.partitionBy("feature", "bin")))
         .withColumn("n_y", F.sum("n_by").over(Window.partitionBy("feature", "y"))))
    term = (F.col("n_by") / F.col("n")) * F.log(F.col("n_by") * F.col("n") / (F.col("n_b") * F.col("n_y")))
    mi = p.groupBy("feature").agg(F.round(F.sum(term), digits).alias("mi"))
    w = Window.orderBy(F.desc("mi"), F.asc("feature"))
    return mi.withColumn("rank", F.row_number().over(w).cast("int"))


def consensus(rankings: list[DataFrame], k: int, col: str = "feature") -> DataFrame:
    """Features in the top k of every ranking (``rank`` column, 1 = best)."""
    sets = [r.where(F.col("rank") <= k).select(col) for r in rankings]
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def selection_summary(selected: DataFrame) -> DataFrame:
    """(target, method, n_features, features sorted) from a long (target, method, feature) table."""
    return selected.groupBy("target", "method").agg(
        F.count(F.lit(1)).cast("long").alias("n_features"),
        F.sort_array(F.collect_list("feature")).alias("features"))

"""Class prototypes and example caps.

Prototypes: class centres are one grouped aggregate (one row per class,
bounded by the category cap, hence broadcast); every row's distance to its
own centre is a column expression; the k nearest per class come from
``row_number() <= k``, which Spark plans as WindowGroupLimit: each map task
keeps only its own best k per class before the shuffle, so a class with a
third of all rows sends k rows per task, not the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .block_search import nearest_rows
from .impute import MeanImputer


def _array_centres(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    return df.groupBy(label).agg(
        F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dim)]).alias("_centre"))


def class_prototypes_vec(df: DataFrame, label: str, vec: str, k: int = 3, key: str = "row_id",
                         dim: int | None = None, digits: int = 6) -> DataFrame:
    """G2 on an array column: (label, rank, row_id, dist)."""
    if dim is None:
        dim = df.select(F.max(F.size(vec)).alias("d")).first()["d"]
    cent = _array_centres(df, label, vec, dim)
    j = df.select(key, label, vec).join(F.broadcast(cent), label)
    sq = F.aggregate(F.zip_with(F.col(vec), F.col("_centre"),
                                lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                     F.lit(0.0), lambda acc, x: acc + x)
    d = j.select(key, label, F.round(F.sqrt(sq), digits).alias("dist"))
    w = Window.partitionBy(label).orderBy("dist", key)
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(label, F.col("rank").cast("int"), key, "dist"))


def class_prototypes(df: DataFrame, label: str, features: list[str], k: int = 3,
                     key: str = "row_id", digits: int = 6) -> DataFrame:
    """G2 on feature columns: mean fill, centre per class, k nearest rows per class.

    The output keeps the raw (unfilled) row values, as the examples show them.
    """
    lab = df.where(F.col(label).isNotNull())
    filled = MeanImputer(features).fit(lab).transform(lab.select(key, label, *features))
    cent = filled.groupBy(label).agg(*[F.avg(f).alias(f"_c_{f}") for f in features])
    j = filled.join(F.broadcast(cent), label)
    sq = sum(((F.col(f) - F.col(f"_c_{f}")) ** 2 for f in features), F.lit(0.0))
    d = j.select(key, label, F.round(F.sqrt(sq), digits).alias("dist"))
    w = Window.partitionBy(label).orderBy("dist", key)
    top = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # k rows per class, as many classes as the broadcast centres: the rows of df are not shuffled
    return lab.select(key, *features).join(F.broadcast(top), key).select(
        label, F.col("rank").cast("int"), key, "dist", *features)


def cap_examples(examples: DataFrame, n: int, label: str = "label") -> DataFrame:
    """Keep the first n examples in (class, rank) order (TakeOrderedAndProject)."""
    return examples.orderBy(label, "rank").limit(n)


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, vec: str = "vec",
                 label: str = "label", key: str = "row_id", digits: int = 9, rows_per_block: int | None = None) -> DataFrame:
    """Exact k-nearest-neighbour vote (uniform weights, ties to the smaller label).

    Returns (row_id, prediction, votes); the search is ``nearest_rows``.
    """
    return knn_votes(nearest_rows(train, test, k, vec, label, key, digits, rows_per_block), k, key)


def knn_votes(nb: DataFrame, k: int, key: str = "row_id") -> DataFrame:
    """Majority vote over the first k neighbours, ties to the smaller label."""
    cnt = (nb.where(F.col("rank") <= k).groupBy(key, F.col("neighbour_label").alias("_y"))
           .agg(F.count(F.lit(1)).alias("votes")))
    w2 = Window.partitionBy(key).orderBy(F.desc("votes"), F.asc("_y"))
    best = cnt.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") == 1)
    return best.select(key, F.col("_y").alias("prediction"), F.col("votes").cast("long"))


def knn_sweep(nb: DataFrame, truth: DataFrame, ks: list[int], key: str = "row_id",
              label: str = "label") -> DataFrame:
    """L18 for the neighbour count: test accuracy for every k from one search.

    ``nb`` holds the first max(ks) neighbours (``nearest_rows``); each
    neighbour row votes for every k at least its rank, so all k are answered
    by one grouped count.  Returns (n_neighbors, test_accuracy, best), best =
    first maximum in ascending k.
    """
    k_arr = F.array(*[F.lit(int(k)) for k in sorted(ks)])
    per_k = nb.select(key, F.col("neighbour_label").alias("_y"),
                      F.explode(F.filter(k_arr, lambda k: k >= F.col("rank"))).alias("n_neighbors"))
    votes = per_k.groupBy(key, "n_neighbors", "_y").agg(F.count(F.lit(1)).alias("_v"))
    w = Window.partitionBy(key, "n_neighbors").orderBy(F.desc("_v"), F.asc("_y"))
    pred = votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    acc = (pred.join(truth.select(key, F.col(label).alias("_t")), key)
           .groupBy("n_neighbors").agg(F.avg((F.col("_y") == F.col("_t")).cast("double")).alias("test_accuracy")))
    # one row per k: the best-k lookup is a tiny aggregate joined on a constant key
    top = acc.agg(F.max("test_accuracy").alias("_m")).withColumn("_one", F.lit(1))
    first = (acc.withColumn("_one", F.lit(1)).join(top, "_one")
             .where(F.col("test_accuracy") == F.col("_m")).agg(F.min("n_neighbors").alias("_best"))
             .withColumn("_one", F.lit(1)))
    return (acc.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")
            .select(F.col("n_neighbors").cast("int"), F.round("test_accuracy", 10).alias("test_accuracy"),
                    (F.col("n_neighbors") == F.col("_best")).alias("best")))

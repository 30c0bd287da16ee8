"""Model zoo on MLlib (L1-L21) and model-based selection (X4, X6; X1-X3 are in ``stepwise``).

Every model is an MLlib estimator over a vector column; data never leaves
the executors except fitted parameters.  Where MLlib lacks a piece the
source pipeline uses, it is composed from MLlib parts:

* gradient boosting and AdaBoost are ``boosting`` (histograms, all classes at
  once, missing cells); MLlib's GBT is binary only and has no penalty;
* RBF kernel classifier: random Fourier features (matrix products inside
  tasks) followed by a linear model;
* extra trees are ``extra_trees`` (MLlib's cuts are not random).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import array_udf, as_array
from .boosting import Spec, added_scores, class_shares, fit_adaboost, fit_boosting
from .extra_trees import fit_extra_trees
from .network import fit_network, hidden_features

MAX_DEPTH = 30  # MLlib's limit stands in for "unlimited"


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Vector column of the (already imputed) feature columns."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def _n_classes(df: DataFrame, label: str) -> int:
    return int(df.agg(F.max(label).alias("m")).first()["m"]) + 1


def _label_double(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double"))


# --------------------------------------------------------------------------- fitted wrappers
@dataclass
class Fitted:
    """Uniform interface: ``predict(df)`` adds ``prediction`` and ``probs``."""
    model: object
    features: str = "features"
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return (out.withColumn("probs", vector_to_array(F.col("probability")))
                .withColumn("prediction", F.col("prediction").cast("int"))
                .drop("rawPrediction", "probability"))


@dataclass
class FourierModel:
    """RBF kernel approximation: z = sqrt(2/D) cos(x W + b), then a linear model."""
    weights: np.ndarray
    offsets: np.ndarray
    inner: Fitted
    cols: list
    def transform_features(self, df: DataFrame) -> DataFrame:
        w, b = self.weights, self.offsets

        def components(x: np.ndarray) -> np.ndarray:
            return np.cos(x @ w + b) * math.sqrt(2.0 / w.shape[1])

        # a matrix product per batch: as column expressions the components outgrow Spark's generated code
        cells = F.array(*[F.col(c).cast("double") for c in self.cols])
        return df.withColumn("_rff", array_to_vector(array_udf(components)(cells)))
    def predict(self, df: DataFrame) -> DataFrame:
        return self.inner.predict(self.transform_features(df)).drop("_rff")


# --------------------------------------------------------------------------- estimators
def logistic(train: DataFrame, label: str, C: float = 1.0, l1: bool = False,
             features: str = "features", max_iter: int = 1000, n: int | None = None) -> Fitted:
    """L2/L3: sklearn's C maps to regParam = 1 / (C n) (loss averaged in MLlib)."""
    n = train.count() if n is None else n
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=1.0 if l1 else 0.0, standardization=False,
                            maxIter=max_iter, family="auto")
    return Fitted(lr.fit(_label_double(train, label)), features)


def tree(train: DataFrame, label: str, max_depth: int | None = None, features="features", seed=42) -> Fitted:
    """L4: decision tree; no depth limit means MLlib's maximum."""
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed,
                                maxDepth=min(max_depth or MAX_DEPTH, MAX_DEPTH))
    return Fitted(dt.fit(_label_double(train, label)), features)


def _room(df: DataFrame) -> int:
    """Bytes of memory that the executors have left for stored blocks."""
    left = df.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    room = 0
    while left.hasNext():
        room += left.next()._2()
    return room


def _ids_fit(train: DataFrame, n_trees: int) -> bool:
    """Whether the executors have room to keep the node of every row in every tree (three versions and the bags,
    four bytes each), so that MLlib need not walk every tree from its root on every level.  The trees are the same."""
    return 16 * train.count() * n_trees <= _room(train)


def forest(train: DataFrame, label: str, n_trees: int = 100, max_depth: int | None = None,
           bootstrap: bool = True, features="features", seed=42, max_bins: int = 32) -> Fitted:
    """Random forest, sqrt features per split."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_trees,
                                maxDepth=min(max_depth or MAX_DEPTH, MAX_DEPTH), seed=seed,
                                featureSubsetStrategy="sqrt", bootstrap=bootstrap, maxBins=max_bins,
                                cacheNodeIds=_ids_fit(train, n_trees))
    return Fitted(rf.fit(_label_double(train, label)), features)


def boosted(train: DataFrame, label: str, n_rounds: int = 100, rate: float = 0.1, depth: int = 3, features="features"):
    """Gradient boosting with one tree per class and round (one for two classes), leaves of any size."""
    return fit_boosting(train, label, Spec(n_rounds, rate, depth), features)


def hist_boosted(train: DataFrame, label: str, n_rounds: int = 100, rate: float = 0.1, depth: int | None = None, l2: float = 0.0,
                 features="features"):
    """Boosting with second derivatives, 31 leaves of at least 20 rows, a penalty on leaves, missing cells as they are."""
    return fit_boosting(train, label, Spec(n_rounds, rate, depth, leaves=31, least=20, l2=l2, least_squares=False), features)


def kernel_scale(train: DataFrame, cols: list[str]) -> float:
    """gamma = 1 / (p * var(X)), the source's 'scale' setting."""
    row = train.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    var = float(np.mean([row[c] or 0.0 for c in cols])) or 1.0
    return 1.0 / (len(cols) * var)


def rbf_classifier(train: DataFrame, label: str, cols: list[str], C: float = 1.0, gamma: float | None = None,
                   n_components: int = 100, seed: int = 42, n: int | None = None, mapped: DataFrame | None = None) -> FourierModel:
    """Random Fourier features for exp(-gamma |x - y|^2) and a logistic model.

    gamma defaults to ``kernel_scale``; ``n`` is the number of rows and ``mapped``
    the rows with their components (``fourier_map``, same gamma and seed), if known.
    """
    fm = fourier_map(train, cols, gamma, n_components, seed)
    n = train.count() if n is None else n
    fm.inner = logistic(fm.transform_features(train) if mapped is None else mapped, label, C=C, features="_rff", n=n)
    return fm


def fourier_map(train: DataFrame, cols: list[str], gamma: float | None = None, n_components: int = 100, seed: int = 42) -> FourierModel:
    """The random components, without a model on them."""
    gamma = kernel_scale(train, cols) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(len(cols), n_components))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    return FourierModel(w, b, None, list(cols))


def fits_at_once(df: DataFrame, row_bytes: int, n: int, most: int = 4) -> int:
    """How many linear fits over n rows of ``row_bytes`` may run side by side: MLlib holds all rows once for each."""
    return max(1, min(most, _room(df) // max(1, row_bytes * n)))


def neural_forest(train: DataFrame, label: str, n_features: int, n_trees: int = 200, hidden=(64, 64),
                  features="features", seed=42):
    """The last hidden layer of a trained network as features for a forest."""
    weights = fit_network(train, label, n_features, max(_n_classes(train, label), 2), hidden, features, seed=seed)
    rf = forest(hidden_features(train, weights, features), label, n_trees, features="hidden", seed=seed)
    return NeuralForest(weights, rf, features)


@dataclass
class NeuralForest:
    weights: list
    rf: Fitted
    features: str
    def predict(self, df):
        return self.rf.predict(hidden_features(df, self.weights, self.features)).drop("hidden")


def append_scores(df: DataFrame, fitted, prefix: str, features="features", out: str | None = None) -> DataFrame:
    """a fitted model's class probabilities appended to the feature vector."""
    pr = fitted.predict(df).withColumnRenamed("probs", f"_{prefix}").drop("prediction")
    arr = F.concat(vector_to_array(F.col(features)), F.col(f"_{prefix}"))
    return pr.withColumn(out or features, array_to_vector(arr)).drop(f"_{prefix}")


@dataclass
class StackModel:
    members: list
    meta: object
    def predict(self, df):
        cur = df
        for i, m in enumerate(self.members):
            cur = append_scores(cur, m, f"m{i}", out="_stack" if i == 0 else "_stack",
                                features="features" if i == 0 else "_stack")
        return self.meta.predict(cur).drop("_stack")


def stack_linear(train: DataFrame, label: str, n_trees: int = 100, seed: int = 42) -> StackModel:
    """Forest + boosting probabilities (in-sample) -> logistic regression."""
    m1 = forest(train, label, n_trees, seed=seed)
    m2 = boosted(train, label, 100, 0.1, 3)
    z = append_scores(append_scores(train, m1, "m0", out="_stack"), m2, "m1", features="_stack", out="_stack")
    meta = logistic(z, label, C=1.0, features="_stack")
    return StackModel([m1, m2], meta)


def stack_refine(train: DataFrame, label: str, n_trees: int = 100, seed: int = 42) -> StackModel:
    """Forest probabilities appended to the features -> a second forest (seed + 1)."""
    m1 = forest(train, label, n_trees, seed=seed)
    z = append_scores(train, m1, "m0", out="_stack")
    meta = forest(z, label, n_trees, features="_stack", seed=seed + 1)
    return StackModel([m1], meta)


# --------------------------------------------------------------------------- committees
def with_members(df: DataFrame, members: list) -> DataFrame:
    """df with the class probabilities of every fitted member (``_m0``, ``_m1`` ...), one projection after the other."""
    for i, m in enumerate(members):
        df = m.predict(df).withColumnRenamed("probs", f"_m{i}").drop("prediction")
    return df


def _mean_of(n: int, of) -> Column:
    return sum((of(F.col(f"_m{i}")) for i in range(1, n)), of(F.col("_m0"))) / n


@dataclass
class SoftVote:
    """The mean of the members' class probabilities, the lower class on ties."""
    members: list
    def predict(self, df: DataFrame) -> DataFrame:
        n = len(self.members)
        total = F.col("_m0")
        for i in range(1, n):
            total = F.zip_with(total, F.col(f"_m{i}"), lambda a, b: a + b)
        out = with_members(df, self.members).withColumn("probs", F.transform(total, lambda s: s / n))
        best = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
        return out.withColumn("prediction", best).drop(*[f"_m{i}" for i in range(n)])


def committee_uncertainty(df: DataFrame, members: list, key: str = "row_id") -> DataFrame:
    """G16 for fitted members: 1 - the mean of their top class probabilities, without a shuffle."""
    return with_members(df, members).select(key, F.round(1 - _mean_of(len(members), F.array_max), 10).alias("uncertainty"))


# --------------------------------------------------------------------------- running
def run_model(fitted, train: DataFrame, test: DataFrame, label: str, key: str = "row_id") -> DataFrame:
    """Predictions for both splits (row_id, split, label, prediction, probs)."""
    out = []
    for name, d in (("train", train), ("test", test)):
        p = fitted.predict(d)
        out.append(p.select(key, F.lit(name).alias("split"), F.col(label).cast("int").alias("label"),
                            "prediction", "probs"))
    return out[0].unionByName(out[1])


def sweep(fit_fn, values: list, train: DataFrame, test: DataFrame, label: str,
          parallelism: int = 4) -> list[tuple]:
    """One parameter over ``values``, scored by test accuracy (the source's rule);
    fits run concurrently from a driver thread pool, executors do the row work.
    Returns [(value, accuracy)], best = first maximum."""
    def one(v):
        p = fit_fn(v).predict(test)
        return v, p.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a")).first()["a"]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(one, values))


def _staged_accuracy(test: DataFrame, label: str, stages: Column) -> list[float]:
    """Accuracy of every stage from an array column of predictions, in one scan."""
    right = F.transform(stages, lambda s: (s == F.col(label)).cast("double"))
    n = len(test.select(stages.alias("s")).first()["s"])
    row = test.select(right.alias("r")).agg(*[F.avg(F.get("r", F.lit(i))).alias(f"a{i}") for i in range(n)]).first()
    return [row[f"a{i}"] for i in range(n)]


def sweep_boosting_rounds(train: DataFrame, test: DataFrame, label: str, values: list[int], rate: float = 0.1, depth: int = 3,
                          features: str = "features") -> list[tuple]:
    """L18 for boosting rounds: the first n rounds of one fit are the fit with n rounds."""
    model = boosted(train, label, max(values), rate, depth, features)

    def stages(x: np.ndarray) -> np.ndarray:
        bins = model.bins.of(x)
        raw, out, done = np.tile(model.start, (len(x), 1)), [], 0
        for n in values:  # rising
            raw = raw + added_scores(model.rounds[done:n], bins, model.rate, len(model.start))
            done = max(done, min(n, len(model.rounds)))
            out.append(class_shares(raw).argmax(axis=1))
        return np.stack(out, axis=1).astype(float)

    return list(zip(values, _staged_accuracy(test, label, array_udf(stages)(as_array(test, features)))))


def importance_rank(fitted: Fitted, names: list[str], top: int = 20) -> list[tuple[str, float]]:
    """Forest importances zipped with names, top ``top``."""
    imp = fitted.model.featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda i: (-imp[i], names[i]))
    return [(names[i], float(imp[i])) for i in order[:top]]


def l1_rank(train: DataFrame, label: str, names: list[str], C: float = 0.1) -> list[tuple[str, float]]:
    """Mean |coefficient| over classes of an L1 logistic model, non-zero only."""
    m = logistic(train, label, C=C, l1=True).model
    coef = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    order = sorted(range(len(names)), key=lambda i: (-coef[i], names[i]))
    return [(names[i], float(coef[i])) for i in order if coef[i] > 0]


# --------------------------------------------------------------------------- L16
@dataclass
class SplineLogistic:
    scaler: object
    spline: object
    names: list
    fitted: Fitted

    def predict(self, df: DataFrame) -> DataFrame:
        return self.fitted.predict(self.spline.assembled(self.scaler.transform(df), "_spl")).drop("_spl")


def spline_logistic(train: DataFrame, label: str, cols: list[str], C: float = 0.5, n_knots: int = 3,
                    max_iter: int = 1000) -> SplineLogistic:
    """Additive spline logistic = F1 standardise -> F2 quadratic splines
    (3 knots, no bias) -> L2 logistic (C=0.5).  Inputs must be imputed first."""
    from .features import SplineBasis, Standardizer
    sc = Standardizer(cols).fit(train)
    tr = sc.transform(train)
    sp = SplineBasis(cols, n_knots).fit(tr)
    names = [f"{c}_sp{j}" for c in cols for j in range(sp.n_outputs())]
    tr = sp.assembled(tr, "_spl")
    return SplineLogistic(sc, sp, names, logistic(tr, label, C=C, features="_spl", max_iter=max_iter))

"""Registered queries: model training and evaluation on the case fixture (L, X).

Training data: ``cases_raw`` encoded (E1-E3), split by T1 on the binary
target, median-imputed with train medians (I1) and assembled into one
vector.  Models are compared on predictions, so these queries take the
driver's rows-only check; their metrics come from the SQL-checked V
operators.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import features as FT
from ..operators import impute as I
from ..operators import metrics as V
from ..operators import models as L
from ..operators import prompts as G
from ..operators import split as T
from ..operators import stepwise as SW
from ..operators.binning import dealt
from ..operators.chained import ChainedImputer
from ..session import stored
from ..sources import fixtures as X
from .cases import SEED, TARGETS, TEST_FRAC
from .registry import query


def split_encoded(spark, sf, target: str = "target_bin"):
    """(split table, feature names): encoded features with nulls kept, an int
    ``label`` and ``split``; persisted because every fit below reads it."""
    df = X.cases_raw(spark, sf)
    feats = [c for c in df.columns if c not in ("row_id", "note_text", *TARGETS)]
    plan = E.fit_encoding(df, feats)
    tenc = E.fit_targets(df, [target])
    enc = df.select("row_id", *plan.expressions(), tenc.code(target).cast("int").alias("label"))
    # memory, spilling to disk; a lost block is recomputed from the scan
    # dealt evenly: the ranks of the split leave a class's rows in one task, and every fit reads the rows as they lie
    split = dealt(T.stratified_split(enc, "label", TEST_FRAC, SEED), df.count()).persist(StorageLevel.MEMORY_AND_DISK)
    return split, plan.feature_names()


def prepared(spark, sf, target: str = "target_bin", missing: str = "median"):
    """(train, test, feature names) with a ``features`` vector and an int label."""
    split, names = split_encoded(spark, sf, target)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    if missing == "native":  # missing cells stay, the features are an array of the raw columns
        cells = F.array(*[F.col(c).cast("double") for c in names]).alias("features")
        return (*(d.select("row_id", "label", cells).persist(StorageLevel.MEMORY_AND_DISK) for d in (train, test)), names)
    if missing == "median":
        m = I.MedianImputer(names).fit(train)
        train, test = m.transform(train), m.transform(test)
    else:  # I5: indicators + sentinel
        m = I.fit_missing_aware(train, names)
        train, test = m.transform(train), m.transform(test)
        names = names + [c + "_missing" for c in names]
    # train mean / population deviation, as the source's scaler step
    sc = FT.Standardizer(names).fit(train)
    train, test = sc.transform(train), sc.transform(test)
    train = L.assemble(train, names).drop("split").persist(StorageLevel.MEMORY_AND_DISK)
    test = L.assemble(test, names).drop("split").persist(StorageLevel.MEMORY_AND_DISK)
    return train, test, names


def _preds(fitted, train, test):
    return L.run_model(fitted, train, test, "label")


def _scored(pred):
    """Binary predictions with the class-1 probability as score."""
    return pred.withColumn("score", F.col("probs")[1])


@query("flagship")
def q_flagship(spark, sf):
    """encode -> stratified split -> median impute -> logistic -> metrics per split."""
    train, test, _ = prepared(spark, sf)
    p = _scored(_preds(L.logistic(train, "label", C=1.0), train, test))
    acc = V.accuracy(p, ["split"]).select("split", "n", "accuracy")
    return acc.join(V.prf_binary(p, ["split"]), "split").join(V.auc(p, ["split"]), "split")


def _model_query(name, fit):
    @query(name)
    def q(spark, sf):
        train, test, names = prepared(spark, sf, missing="native" if name.startswith("fit_hist_boosted") else "median")
        f = fit(train, names)
        return _preds(f, train, test)
    q.__name__ = f"q_{name}"
    return q


_model_query("fit_logistic", lambda tr, n: L.logistic(tr, "label", C=1.0))
_model_query("fit_l1_logistic", lambda tr, n: L.logistic(tr, "label", C=0.1, l1=True))
_model_query("fit_tree", lambda tr, n: L.tree(tr, "label", None))
_model_query("fit_forest", lambda tr, n: L.forest(tr, "label", 100))
_model_query("fit_boosted", lambda tr, n: L.boosted(tr, "label", 100, 0.1, 3))
_model_query("fit_hist_boosted", lambda tr, n: L.hist_boosted(tr, "label", 100, 0.1))
_model_query("fit_hist_boosted_l2", lambda tr, n: L.hist_boosted(tr, "label", 200, 0.05, 5, 0.1))
_model_query("fit_extra_trees", lambda tr, n: L.fit_extra_trees(tr, "label", 300))
_model_query("fit_adaboost", lambda tr, n: L.fit_adaboost(tr, "label", 300, 0.05))
_model_query("fit_adaboost_shares", lambda tr, n: L.fit_adaboost(tr, "label", 100, 1.0, probability=True))
_model_query("fit_rbf", lambda tr, n: L.rbf_classifier(tr, "label", n, C=1.0))
_model_query("fit_stack_linear", lambda tr, n: L.stack_linear(tr, "label", 200))
_model_query("fit_stack_refine", lambda tr, n: L.stack_refine(tr, "label", 200))
_model_query("fit_spline_logistic", lambda tr, n: L.spline_logistic(tr, "label", n, C=0.5))
_model_query("fit_soft_vote_depths", lambda tr, n: L.SoftVote([L.boosted(tr, "label", 150, 0.05, d) for d in (2, 4)]))
_model_query("fit_neural_forest", lambda tr, n: L.neural_forest(tr, "label", len(n), 200, hidden=(64, 64)))


@query("fit_boosted_multi")
def q_fit_boosted_multi(spark, sf):
    train, test, _ = prepared(spark, sf, target="target_multi")
    return _preds(L.boosted(train, "label", 100, 0.1, 3), train, test)


@query("model_metrics")
def q_model_metrics(spark, sf):
    """V1/V2/V5 for three models, long format (the experiment table, L19)."""
    train, test, names = prepared(spark, sf)
    runs = {"logistic": L.logistic(train, "label"), "tree": L.tree(train, "label", 5),
            "forest": L.forest(train, "label", 50)}
    preds = None
    for name, f in runs.items():
        p = _scored(_preds(f, train, test)).withColumns(
            {"target": F.lit("target_bin"), "features": F.lit("full"), "model": F.lit(name)})
        preds = p if preds is None else preds.unionByName(p)
    return V.run_metrics(preds)


# fixed values: the grids of the reference's parameter sweeps (the neighbour count is in q_prompts)
FOREST_TREES = [10, 25, 50, 75, 100, 150, 200, 250, 300]
BOOSTING_ROUNDS = [25, 50, 75, 100, 125, 150, 200]
KERNEL_C = [0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
TREE_DEPTH = [2, 3, 4, 5, 6, 7, 8, 10, 12, 15, None]
LOGISTIC_C = [0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0]


def _sweep_table(spark, found, schema: str):
    """(value, test_accuracy, best): best is the first maximum."""
    top = max(a for _, a in found)
    first = next(i for i, (_, a) in enumerate(found) if a == top)
    return spark.createDataFrame([(v, a, i == first) for i, (v, a) in enumerate(found)], f"{schema}, test_accuracy double, best boolean")


@query("sweep_tree_depth")
def q_sweep_tree_depth(spark, sf):
    """Tree depth; the null depth is a tree without a limit."""
    train, test, _ = prepared(spark, sf)
    return _sweep_table(spark, L.sweep(lambda d: L.tree(train, "label", d), TREE_DEPTH, train, test, "label"), "max_depth int")


@query("sweep_forest_trees")
def q_sweep_forest_trees(spark, sf):
    train, test, _ = prepared(spark, sf)
    return _sweep_table(spark, L.sweep(lambda n: L.forest(train, "label", n), FOREST_TREES, train, test, "label"), "n_trees int")


@query("sweep_boosting_rounds")
def q_sweep_boosting_rounds(spark, sf):
    """Boosting rounds, all from one fit of the most rounds."""
    train, test, _ = prepared(spark, sf)
    return _sweep_table(spark, L.sweep_boosting_rounds(train, test, "label", BOOSTING_ROUNDS), "n_rounds int")


@query("sweep_logistic_c")
def q_sweep_logistic_c(spark, sf):
    train, test, _ = prepared(spark, sf)
    n = train.count()
    return _sweep_table(spark, L.sweep(lambda c: L.logistic(train, "label", C=c, n=n), LOGISTIC_C, train, test, "label"), "c double")


@query("sweep_kernel_c")
def q_sweep_kernel_c(spark, sf):
    train, test, names = prepared(spark, sf)
    n, gamma = train.count(), L.kernel_scale(train, names)
    # the components are the same for every C: computed once, and no more fits at once than the executors hold
    fm = L.fourier_map(train, names, gamma)
    mapped = fm.transform_features(train).select("label", "_rff").persist(StorageLevel.MEMORY_AND_DISK)
    mapped.count()
    found = L.sweep(lambda c: L.rbf_classifier(train, "label", names, C=c, gamma=gamma, n=n, mapped=mapped), KERNEL_C, train, test, "label",
                    L.fits_at_once(train, 8 * fm.weights.shape[1], n))
    mapped.unpersist()
    return _sweep_table(spark, found, "c double")


@query("importance_rank")
def q_importance_rank(spark, sf):
    train, test, names = prepared(spark, sf)
    r = L.importance_rank(L.forest(train, "label", 100), names, 20)
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(r)],
                                 "feature string, importance double, rank int")


@query("l1_rank")
def q_l1_rank(spark, sf):
    train, test, names = prepared(spark, sf)
    r = L.l1_rank(train, "label", names, C=0.1)
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(r)],
                                 "feature string, importance double, rank int")


def _selected(spark, sf, select):
    """(names, what ``select`` takes) over the folded training rows (5 folds)."""
    train, _, names = prepared(spark, sf)
    folded = T.assign_folds(train.select("row_id", "label", "features"), "label", 5, SEED)
    return names, select(folded, "label", names)


@query("forward_select")
def q_forward_select(spark, sf):
    """Greedy forward selection by 5-fold accuracy to min(15, p / 2) features, in the order taken."""
    _, chosen = _selected(spark, sf, SW.forward_select)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "step int, feature string")


@query("backward_select")
def q_backward_select(spark, sf):
    """Greedy backward elimination by 5-fold accuracy from all features to max(5, half)."""
    names, kept = _selected(spark, sf, SW.backward_select)
    return spark.createDataFrame([(c, c in kept) for c in names], "feature string, kept boolean")


@query("forward_backward")
def q_forward_backward(spark, sf):
    """Forward to min(20, p / 2), then backward to max(5, half of those)."""
    names, kept = _selected(spark, sf, SW.forward_backward)
    return spark.createDataFrame([(c, c in kept) for c in names], "feature string, kept boolean")


@query("boundary_hybrid")
def q_boundary_hybrid(spark, sf):
    """Base forest; committee (forest, boosting, extra trees) uncertainty; rows above
    the train threshold take the alternate model's label (here a depth-3 tree)."""
    train, test, _ = prepared(spark, sf)
    base = L.forest(train, "label", 300)
    committee = [L.forest(train, "label", 200, seed=7), L.boosted(train, "label", 100),
                 L.fit_extra_trees(train, "label", 200)]
    seen = L.committee_uncertainty(train, committee).persist(StorageLevel.MEMORY_AND_DISK)  # used twice: threshold and boundary
    thr = G.boundary_threshold(seen, 0.2).first()["threshold"]
    boundary = train.join(seen.where(F.col("uncertainty") > thr), "row_id", "left_semi")
    alt = L.tree(boundary, "label", 3)
    b = base.predict(test).select("row_id", "prediction", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))
    a = alt.predict(test).select("row_id", "prediction")
    return G.route(b, a, L.committee_uncertainty(test, committee), thr, 2)


@query("compare_imputers")
def q_compare_imputers(spark, sf):
    """The same models after each imputer (median, exact k-NN, chained
    equations), every imputer fitted on train and applied to test; long
    metrics table (target, imputer, model, split, metric, value)."""
    from ..operators.knn_impute import KnnImputer
    split, names = split_encoded(spark, sf)
    lab = split.select("row_id", "label", "split")
    is_train = F.col("split") == "train"
    train, test = split.where(is_train), split.where(~is_train)
    med = I.MedianImputer(names).fit(train)
    knn_all = stored(KnnImputer(names, k=5).fit(train).transform(split).join(lab, "row_id"), "knn")  # one search for both splits
    chained = ChainedImputer(names, max_iter=20, tol=1e-3)
    ch_train, _ = chained.fit_transform(train)
    variants = {"median": (med.transform(train), med.transform(test)),
                "knn": (knn_all.where(is_train), knn_all.where(~is_train)),
                "chained": (ch_train.join(lab, "row_id"), chained.transform(test).join(lab, "row_id"))}
    made = {imputer: [L.assemble(d.select("row_id", "label", *names), names).persist(StorageLevel.MEMORY_AND_DISK) for d in pair]
            for imputer, pair in variants.items()}
    models = {"spline_logistic": lambda tr: L.spline_logistic(tr, "label", names, C=0.5),
              "boosted": lambda tr: L.boosted(tr, "label", 20, 0.05, 3)}
    runs = [(imputer, model) for imputer in made for model in models]
    with ThreadPoolExecutor(max_workers=4) as ex:  # as in ``sweep``: most of a fit is short jobs
        fitted = list(ex.map(lambda run: models[run[1]](made[run[0]][0]), runs))
    preds = None
    for (imputer, model), f in zip(runs, fitted):
        p = _scored(_preds(f, *made[imputer])).withColumns(
            {"target": F.lit("target_bin"), "imputer": F.lit(imputer), "model": F.lit(model)})
        preds = p if preds is None else preds.unionByName(p)
    # one row per (row, model): small next to the inputs, read by every metric job
    return V.run_metrics(preds.persist(StorageLevel.MEMORY_AND_DISK), keys=["target", "imputer", "model"])

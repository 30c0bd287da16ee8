"""Registered queries: imputation, features, exploration, evaluation, selection
(I, F, A, V, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import explore as A
from ..operators import features as FT
from ..operators import impute as I
from ..operators import metrics as V
from ..operators import select as XS
from ..operators.chained import ChainedImputer
from ..sources import fixtures as X
from .cases import BIN_CLASSES, ENCODED, MULTI_CLASSES, NUM, TARGETS
from .q_prepare import ENCODE_CASES_SQL, TARGET_SQL
from .registry import query

W = X.with_clause
R8 = 8


def _cases(spark, sf):
    return X.cases_raw(spark, sf)


def _encoded(spark, sf):
    """Encoded features plus numeric target codes y_multi / y_bin."""
    df = _cases(spark, sf)
    feats = [c for c in df.columns if c not in ("row_id", "note_text", *TARGETS)]
    plan = E.fit_encoding(df, feats)
    tenc = E.fit_targets(df, TARGETS)
    return df.select("row_id", *plan.expressions(),
                     tenc.code("target_multi").cast("int").alias("y_multi"),
                     tenc.code("target_bin").cast("int").alias("y_bin"))


ENC_SQL = (f", enc as (select e.*, t.target_multi as y_multi, t.target_bin as y_bin from "
           f"({ENCODE_CASES_SQL}) e join ({TARGET_SQL}) t on e.row_id = t.row_id)\n")


def _r(col, d=R8):
    return F.round(F.col(col), d).alias(col)


# --------------------------------------------------------------------------- I
@query("median_impute", W("cases_raw") + f"""
select row_id, {', '.join(f'round(coalesce({c}, (select median({c}) from cases_raw)), 8) as {c}' for c in NUM)}
from cases_raw""")
def q_median_impute(spark, sf):
    df = _cases(spark, sf).select("row_id", *NUM)
    out = I.MedianImputer(NUM).fit(df).transform(df)
    return out.select("row_id", *[_r(c) for c in NUM])


@query("column_medians", W("cases_raw") + " union all ".join(
    f"select '{c}' as feature, round(median({c}), 8) as median from cases_raw" for c in NUM))
def q_column_medians(spark, sf):
    m = I.column_medians(_cases(spark, sf), NUM)
    return m.select("feature", _r("median"))


@query("mean_fill", W("cases_raw") + f"""
select row_id, {', '.join(f'round(coalesce({c}, (select avg({c}) from cases_raw)), 8) as {c}' for c in NUM)}
from cases_raw""")
def q_mean_fill(spark, sf):
    df = _cases(spark, sf).select("row_id", *NUM)
    return I.mean_fill(df, NUM).select("row_id", *[_r(c) for c in NUM])


@query("missing_aware_features", W("cases_raw") + f"""
, mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in NUM)} from cases_raw)
select row_id, {', '.join(f'round(coalesce({c}, lo_{c} - (hi_{c} - lo_{c}) - 1.0), 8) as {c}, cast({c} is null as double) as {c}_missing' for c in NUM)}
from cases_raw, mm""")
def q_missing_aware(spark, sf):
    df = _cases(spark, sf).select("row_id", *NUM)
    out = I.fit_missing_aware(df, NUM).transform(df)
    return out.select("row_id", *[x for c in NUM for x in (_r(c), F.col(f"{c}_missing"))])


@query("standardize", W("cases_raw") + f"""
, st as (select {', '.join(f'avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) as s_{c}' for c in NUM)} from cases_raw)
select row_id, {', '.join(f'round(({c} - m_{c}) / s_{c}, 8) as {c}' for c in NUM)} from cases_raw, st""")
def q_standardize(spark, sf):
    df = _cases(spark, sf).select("row_id", *NUM)
    out = FT.Standardizer(NUM).fit(df).transform(df)
    return out.select("row_id", *[_r(c) for c in NUM])


def _spline_sql(c):
    parts = []
    for j in range(3):
        u = f"((least(greatest({c}, lo_{c}), hi_{c}) - (lo_{c} - 2 * h_{c} + {j} * h_{c})) / h_{c})"
        parts.append(
            f"round(case when {c} is null then null "
            f"when {u} >= 0 and {u} < 1 then {u} * {u} / 2 "
            f"when {u} >= 1 and {u} < 2 then (-2 * {u} * {u} + 6 * {u} - 3) / 2 "
            f"when {u} >= 2 and {u} < 3 then (3 - {u}) * (3 - {u}) / 2 else 0.0 end, 8) as {c}_sp{j}")
    return ", ".join(parts)


_SPL = ["total_price", "sum_qty"]


@query("spline_basis", W("cases_raw") + f"""
, mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}, (max({c}) - min({c})) / 2 as h_{c}' for c in _SPL)} from cases_raw)
select row_id, {', '.join(_spline_sql(c) for c in _SPL)} from cases_raw, mm""")
def q_spline_basis(spark, sf):
    df = _cases(spark, sf).select("row_id", *_SPL)
    out = FT.SplineBasis(_SPL).fit(df).transform(df)
    cols = [f"{c}_sp{j}" for c in _SPL for j in range(3)]
    return out.select("row_id", *[_r(c) for c in cols])


# --------------------------------------------------------------------------- A
def _pairs_sql(cols, src="enc"):
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append(f"select '{a}' as feature_a, '{b}' as feature_b, corr(\"{a}\", \"{b}\") as c from {src}")
    return " union all ".join(out)


@query("corr_matrix", W("cases_raw") + ENC_SQL + f"""
select feature_a, feature_b, round(c, 8) as corr from ({_pairs_sql(ENCODED)}) t
where c is not null and not isnan(c)""")
def q_corr_matrix(spark, sf):
    return A.corr_matrix(_encoded(spark, sf), ENCODED)


_TCORR_SQL = " union all ".join(
    f"select '{f}' as feature, '{t}' as target, corr(\"{f}\", {t}) as c from enc"
    for f in ENCODED for t in ("y_multi", "y_bin"))


@query("target_corr", W("cases_raw") + ENC_SQL + f"""
select feature, target, round(c, 8) as corr from ({_TCORR_SQL}) t where c is not null and not isnan(c)""")
def q_target_corr(spark, sf):
    return A.target_corr(_encoded(spark, sf), ENCODED, ["y_multi", "y_bin"])


@query("top_corr", W("cases_raw") + ENC_SQL + f"""
, tc as (select feature, target, round(c, 8) as corr from ({_TCORR_SQL}) t where c is not null and not isnan(c)),
rk as (select target, cast(row_number() over (partition by target order by abs(corr) desc, feature) as int) as rank,
         feature, corr, case when corr >= 0 then '+' else '-' end as sign from tc)
select * from rk where rank <= 5""")
def q_top_corr(spark, sf):
    return A.top_corr(A.target_corr(_encoded(spark, sf), ENCODED, ["y_multi", "y_bin"]), 5)


_COUNTS_SQL = """select 'target_multi' as target, target_multi as class, cast(count(*) as bigint) as n
  from cases_raw where target_multi is not null group by 2
  union all select 'target_bin', target_bin, cast(count(*) as bigint) from cases_raw where target_bin is not null group by 2"""


@query("target_counts", W("cases_raw") + _COUNTS_SQL)
def q_target_counts(spark, sf):
    return A.target_counts(_cases(spark, sf), TARGETS)


@query("class_balance", W("cases_raw") + f"""
select target, cast(dense_rank() over (partition by target order by class) - 1 as int) as code,
  class as label, n, round(n * 100.0 / sum(n) over (partition by target), 6) as pct
from ({_COUNTS_SQL}) t""")
def q_class_balance(spark, sf):
    return A.class_balance(_cases(spark, sf), TARGETS)


_LONG_SQL = " union all ".join(
    f"select row_id, target_multi as class, '{c}' as feature, {c} as value from cases_raw "
    f"where {c} is not null and target_multi is not null" for c in NUM)


@query("box_stats", W("cases_raw") + f"""
, lv as ({_LONG_SQL}),
q as (select feature, class, count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med,
        quantile_cont(value, 0.75) as q3 from lv group by feature, class),
f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select f.feature, f.class, cast(f.n as bigint) as n, round(f.q1, 8) as q1, round(f.med, 8) as median,
  round(f.q3, 8) as q3,
  round(min(case when lv.value >= f.lo and lv.value <= f.hi then lv.value end), 8) as whisker_low,
  round(max(case when lv.value >= f.lo and lv.value <= f.hi then lv.value end), 8) as whisker_high,
  cast(sum(case when lv.value >= f.lo and lv.value <= f.hi then 0 else 1 end) as bigint) as n_outliers
from f join lv on f.feature = lv.feature and f.class = lv.class
group by f.feature, f.class, f.n, f.q1, f.med, f.q3""")
def q_box_stats(spark, sf):
    return A.box_stats(_cases(spark, sf), NUM, "target_multi")


@query("box_outliers", W("cases_raw") + f"""
, lv as ({_LONG_SQL}),
q as (select feature, class, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from lv group by all),
f as (select feature, class, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select lv.row_id, lv.feature, lv.class, lv.value from lv join f on lv.feature = f.feature and lv.class = f.class
where lv.value < f.lo or lv.value > f.hi""")
def q_box_outliers(spark, sf):
    return A.box_outliers(_cases(spark, sf), NUM, "target_multi")


_BIN_FEATS = ["line_status"] + [c for c in ENCODED if c.startswith("segment_")]


@query("binary_rates", W("cases_raw") + ENC_SQL + " union all ".join(
    f"""select '{f}' as feature, "{f}" as value, 'y_bin' as target, cast(count(*) as bigint) as n,
      round(avg(case when y_bin = 1 then 100.0 else 0.0 end), 6) as pct_positive
    from enc where "{f}" is not null and y_bin is not null group by "{f}" """ for f in _BIN_FEATS))
def q_binary_rates(spark, sf):
    return A.binary_rates(_encoded(spark, sf), _BIN_FEATS, ["y_bin"])


_PB = ["total_price", "acct_bal", "n_lines"]


def _bin_sql(c):
    return (f"case when {c} is null then null when hi_{c} = lo_{c} then 0 else cast(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10), 9) as int) end")


@query("pair_bins", W("cases_raw") + f"""
, mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in _PB)} from cases_raw),
b as (select target_multi as class, {', '.join(f'{_bin_sql(c)} as b_{c}' for c in _PB)} from cases_raw, mm)
""" + " union all ".join(
    f"select '{a}' as feature_x, '{c}' as feature_y, class, b_{a} as bin_x, b_{c} as bin_y, cast(count(*) as bigint) as n "
    f"from b where b_{a} is not null and b_{c} is not null group by class, b_{a}, b_{c}"
    for i, a in enumerate(_PB) for j, c in enumerate(_PB) if j >= i))
def q_pair_bins(spark, sf):
    return A.pair_bins(_cases(spark, sf), _PB, "target_multi", 10)


# --------------------------------------------------------------------------- V on pred_bin / pred_multi
@query("accuracy", W("pred_bin") + """
select split, cast(count(*) as bigint) as n, round(avg(case when label = prediction then 1.0 else 0.0 end), 8) as accuracy,
  round(1 - avg(case when label = prediction then 1.0 else 0.0 end), 8) as error_rate from pred_bin group by split""")
def q_accuracy(spark, sf):
    return V.accuracy(X.pred_bin(spark, sf), ["split"])


_PRF_BIN = """
select split,
  round(coalesce(cast(sum(case when label = 1 and prediction = 1 then 1 else 0 end) as double) / nullif(sum(case when prediction = 1 then 1 else 0 end), 0), 0.0), 8) as precision,
  round(coalesce(cast(sum(case when label = 1 and prediction = 1 then 1 else 0 end) as double) / nullif(sum(case when label = 1 then 1 else 0 end), 0), 0.0), 8) as recall,
  round(coalesce(2.0 * sum(case when label = 1 and prediction = 1 then 1 else 0 end) / nullif(sum(case when prediction = 1 then 1 else 0 end) + sum(case when label = 1 then 1 else 0 end), 0), 0.0), 8) as f1
from pred_bin group by split"""


@query("prf_binary", W("pred_bin") + _PRF_BIN)
def q_prf_binary(spark, sf):
    return V.prf_binary(X.pred_bin(spark, sf), ["split"])


@query("prf_weighted", W("pred_multi") + """
, cl as (select label as class, 1 as is_true, case when label = prediction then 1 else 0 end as hit from pred_multi
         union all select prediction, 0, 0 from pred_multi),
c as (select class, sum(hit) as tp, sum(1 - is_true) as n_pred, sum(is_true) as n_true from cl group by class),
m as (select n_true as w, coalesce(cast(tp as double) / nullif(n_pred, 0), 0.0) as p,
        coalesce(cast(tp as double) / nullif(n_true, 0), 0.0) as r,
        coalesce(2.0 * tp / nullif(n_pred + n_true, 0), 0.0) as f from c)
select round(sum(p * w) / sum(w), 8) as precision, round(sum(r * w) / sum(w), 8) as recall,
  round(sum(f * w) / sum(w), 8) as f1 from m""")
def q_prf_weighted(spark, sf):
    return V.prf_weighted(X.pred_multi(spark, sf))


@query("confusion", W("pred_multi") + """
, cls as (select distinct c from (select label as c from pred_multi union all select prediction from pred_multi) t),
grid as (select a.c as label, b.c as prediction from cls a, cls b),
cnt as (select label, prediction, count(*) as n from pred_multi group by all)
select grid.label, grid.prediction, cast(coalesce(cnt.n, 0) as bigint) as n
from grid left join cnt on grid.label = cnt.label and grid.prediction = cnt.prediction""")
def q_confusion(spark, sf):
    return V.confusion(X.pred_multi(spark, sf))


@query("confusion_by_split", W("pred_bin") + """
, cls as (select distinct split, c from (select split, label as c from pred_bin union all select split, prediction from pred_bin) t),
grid as (select a.split, a.c as label, b.c as prediction from cls a join cls b on a.split = b.split),
cnt as (select split, label, prediction, count(*) as n from pred_bin group by all)
select grid.split, grid.label, grid.prediction, cast(coalesce(cnt.n, 0) as bigint) as n
from grid left join cnt on grid.split = cnt.split and grid.label = cnt.label and grid.prediction = cnt.prediction""")
def q_confusion_by_split(spark, sf):
    return V.confusion(X.pred_bin(spark, sf), ["split"])


def _roc_sql(src, groups, label="label", score="score"):
    g = ", ".join(groups)
    gp = f"partition by {g} " if groups else ""
    gsel = f"{g}, " if groups else ""
    return f"""
, sc as (select {gsel}cast({score} as double) as threshold, sum(case when {label} = 1 then 1 else 0 end) as pos,
           sum(case when {label} = 1 then 0 else 1 end) as neg from {src} group by {gsel}threshold),
cum as (select *, coalesce(sum(pos) over ({gp}order by threshold desc rows between unbounded preceding and 1 preceding), 0) as pos_above,
           coalesce(sum(neg) over ({gp}order by threshold desc rows between unbounded preceding and 1 preceding), 0) as neg_above,
           sum(pos) over ({gp.strip() or ''}) as p_tot, sum(neg) over ({gp.strip() or ''}) as n_tot from sc)
"""


@query("roc_points", W("pred_bin") + _roc_sql("pred_bin", ["split"]) + """
select split, threshold, cast(pos_above + pos as bigint) as tp, cast(neg_above + neg as bigint) as fp,
  round(cast(pos_above + pos as double) / p_tot, 8) as tpr, round(cast(neg_above + neg as double) / n_tot, 8) as fpr
from cum""")
def q_roc_points(spark, sf):
    return V.roc_points(X.pred_bin(spark, sf), ["split"])


@query("auc", W("pred_bin") + _roc_sql("pred_bin", ["split"]) + """
select split, round(sum(neg * (pos_above + 0.5 * pos)) / (sum(pos) * sum(neg)), 8) as auc from cum group by split""")
def q_auc(spark, sf):
    return V.auc(X.pred_bin(spark, sf), ["split"])


_OVR = """
, ovr as (select label as y, 0 as class, p0 as score from pred_multi union all
          select label, 1, p1 from pred_multi union all select label, 2, p2 from pred_multi),
bin as (select class, case when y = class then 1 else 0 end as label, score from ovr)"""


@query("auc_ovr", W("pred_multi") + _OVR + _roc_sql("bin", ["class"]) + """
, per as (select class, sum(neg * (pos_above + 0.5 * pos)) / (sum(pos) * sum(neg)) as auc, sum(pos) as n from cum group by class)
select round(sum(auc * n) / sum(n), 8) as auc_ovr from per""")
def q_auc_ovr(spark, sf):
    return V.auc_ovr(X.pred_multi(spark, sf), ["p0", "p1", "p2"])


@query("roc_micro", W("pred_multi") + _OVR + _roc_sql("bin", []) + """
select threshold, cast(pos_above + pos as bigint) as tp, cast(neg_above + neg as bigint) as fp,
  round(cast(pos_above + pos as double) / p_tot, 8) as tpr, round(cast(neg_above + neg as double) / n_tot, 8) as fpr
from cum""")
def q_roc_micro(spark, sf):
    return V.roc_micro(X.pred_multi(spark, sf), ["p0", "p1", "p2"])


@query("auc_micro", W("pred_multi") + _OVR + _roc_sql("bin", []) + """
select round(sum(neg * (pos_above + 0.5 * pos)) / (sum(pos) * sum(neg)), 8) as auc_micro from cum""")
def q_auc_micro(spark, sf):
    return V.auc_micro(X.pred_multi(spark, sf), ["p0", "p1", "p2"])


# --------------------------------------------------------------------------- runs: A9-A13, V8-V10
_RK = ["target", "features", "model", "split"]
RUNM_SQL = """
, g as (select target, features, model, split,
          avg(case when label = prediction then 1.0 else 0.0 end) as accuracy,
          sum(case when label = 1 and prediction = 1 then 1 else 0 end) as tp,
          sum(case when prediction = 1 then 1 else 0 end) as pp, sum(case when label = 1 then 1 else 0 end) as ap
        from run_predictions group by all),
sc as (select target, features, model, split, score as threshold, sum(label) as pos, sum(1 - label) as neg
       from run_predictions group by all),
sa as (select *, coalesce(sum(pos) over (partition by target, features, model, split order by threshold desc
         rows between unbounded preceding and 1 preceding), 0) as pos_above from sc),
au as (select target, features, model, split, sum(neg * (pos_above + 0.5 * pos)) / (sum(pos) * sum(neg)) as auc
       from sa group by all),
runm as (
  select target, features, model, split, 'accuracy' as metric, round(accuracy, 8) as value from g
  union all select target, features, model, split, 'precision', round(coalesce(cast(tp as double) / nullif(pp, 0), 0.0), 8) from g
  union all select target, features, model, split, 'recall', round(coalesce(cast(tp as double) / nullif(ap, 0), 0.0), 8) from g
  union all select target, features, model, split, 'f1', round(coalesce(2.0 * tp / nullif(pp + ap, 0), 0.0), 8) from g
  union all select target, features, model, split, 'auc', round(auc, 8) from au)
"""


def _runm(spark, sf):
    return V.run_metrics(X.run_predictions(spark, sf))


@query("run_metrics", W("run_predictions") + RUNM_SQL + "select * from runm")
def q_run_metrics(spark, sf):
    return _runm(spark, sf)


@query("run_metrics_multi", W("pred_multi") + """
, pm as (select *, case when row_id % 5 = 0 then 'test' else 'train' end as split from pred_multi),
cl as (select split, label as class, 1 as is_true, case when label = prediction then 1 else 0 end as hit from pm
       union all select split, prediction, 0, 0 from pm),
c as (select split, class, sum(hit) as tp, sum(1 - is_true) as n_pred, sum(is_true) as n_true from cl group by all),
m as (select split, n_true as w, coalesce(cast(tp as double) / nullif(n_pred, 0), 0.0) as p,
        coalesce(cast(tp as double) / nullif(n_true, 0), 0.0) as r,
        coalesce(2.0 * tp / nullif(n_pred + n_true, 0), 0.0) as f from c),
ovr as (select split, label as y, 0 as class, p0 as score from pm union all select split, label, 1, p1 from pm
        union all select split, label, 2, p2 from pm),
sc as (select split, class, score, sum(case when y = class then 1 else 0 end) as pos,
         sum(case when y = class then 0 else 1 end) as neg from ovr group by all),
sa as (select *, coalesce(sum(pos) over (partition by split, class order by score desc
         rows between unbounded preceding and 1 preceding), 0) as pos_above from sc),
au as (select split, class, sum(neg * (pos_above + 0.5 * pos)) / (sum(pos) * sum(neg)) as auc, sum(pos) as n from sa group by all),
v as (select split, 'accuracy' as metric, avg(case when label = prediction then 1.0 else 0.0 end) as value from pm group by split
  union all select split, 'precision', sum(p * w) / sum(w) from m group by split
  union all select split, 'recall', sum(r * w) / sum(w) from m group by split
  union all select split, 'f1', sum(f * w) / sum(w) from m group by split
  union all select split, 'auc', sum(auc * n) / sum(n) from au group by split)
select 'shares' as model, split, metric, round(value, 8) as value from v""")
def q_run_metrics_multi(spark, sf):
    pred = X.pred_multi(spark, sf).select("*", F.lit("shares").alias("model"), F.when(
        F.col("row_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return V.run_metrics(pred, ["model"], prob_cols=["p0", "p1", "p2"])


@query("metric_pivot", W("run_predictions") + RUNM_SQL + """
select model, round(avg(case when target || '_' || features = 'bin_full' then value end), 8) as bin_full,
  round(avg(case when target || '_' || features = 'bin_selected' then value end), 8) as bin_selected
from runm where metric = 'f1' and split = 'test' group by model""")
def q_metric_pivot(spark, sf):
    return A.metric_pivot(_runm(spark, sf), "f1", ["bin_full", "bin_selected"])


_RUNS = [f"{m}_{f}" for m, _ in X.RUN_MODELS for f in ("full", "selected")]


@query("prediction_corr", W("run_predictions") + f"""
, wide as (select row_id, {', '.join(f"max(case when model || '_' || features = '{r}' then prediction end) as {r}" for r in _RUNS)}
           from run_predictions where split = 'test' group by row_id)
select model_a, model_b, round(c, 8) as corr from (
  {' union all '.join(f"select '{a}' as model_a, '{b}' as model_b, corr({a}, {b}) as c from wide" for i, a in enumerate(_RUNS) for b in _RUNS[i + 1:])}
) t where c is not null and not isnan(c)""")
def q_prediction_corr(spark, sf):
    p = (X.run_predictions(spark, sf).where(F.col("split") == "test")
         .withColumn("run", F.concat_ws("_", "model", "features")))
    return A.prediction_corr(p, _RUNS)


@query("rank_runs", W("run_predictions") + RUNM_SQL + """
select target, features, model, round(1 - value, 8) as error,
  cast(row_number() over (partition by target order by round(1 - value, 8), features, model) as int) as rank
from runm where metric = 'accuracy' and split = 'test'""")
def q_rank_runs(spark, sf):
    return A.rank_runs(_runm(spark, sf))


@query("best_model", W("run_predictions") + RUNM_SQL + """
select target, features, model, f1 from (
  select target, features, model, value as f1,
    row_number() over (partition by target order by value desc, features, model) as r
  from runm where metric = 'f1' and split = 'test') t where r = 1""")
def q_best_model(spark, sf):
    return A.best_model(_runm(spark, sf), "f1")


def _pick(m, s):
    return f"max(case when metric = '{m}' and split = '{s}' then value end)"


@query("overfit_report", W("run_predictions") + RUNM_SQL + f"""
select target, features, model,
  {', '.join(f"{_pick(m, s)} as {s}_{m}" for m in ('accuracy', 'f1', 'auc') for s in ('train', 'test'))},
  {', '.join(f"round({_pick(m, 'train')} - {_pick(m, 'test')}, 8) as diff_{m}" for m in ('accuracy', 'f1', 'auc'))},
  {_pick('accuracy', 'train')} - {_pick('accuracy', 'test')} > 0.1 as overfit
from runm group by target, features, model""")
def q_overfit_report(spark, sf):
    return V.overfit_report(_runm(spark, sf))


@query("summary", W("run_predictions") + RUNM_SQL + f"""
select target, features, model,
  {', '.join(f"{_pick(m, s)} as {s}_{m}" for s in ('train', 'test') for m in ('accuracy', 'precision', 'recall', 'f1', 'auc'))}
from runm group by target, features, model""")
def q_summary(spark, sf):
    return V.summary(_runm(spark, sf))


@query("selection_impact", W("run_predictions") + RUNM_SQL + """
, t as (select * from runm where metric = 'accuracy' and split = 'test')
select a.target, a.model, a.value as full_value, b.value as selected_value, round(b.value - a.value, 8) as difference
from t a join t b on a.target = b.target and a.model = b.model where a.features = 'full' and b.features = 'selected'""")
def q_selection_impact(spark, sf):
    return V.selection_impact(_runm(spark, sf))


# --------------------------------------------------------------------------- X
_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


@query("mi_rank", W("cases_raw") + f"""
, lab as (select * from cases_raw where target_bin is not null),
lv as ({' union all '.join(f"select '{c}' as feature, {c} as value, target_bin as y from lab where {c} is not null" for c in NUM)}),
ed as (select feature, quantile_cont(value, [{_EDGES}]) as edges from lv group by feature),
b as (select lv.feature, lv.y, len(list_filter(ed.edges, lambda e: e < lv.value)) as bin from lv join ed on lv.feature = ed.feature),
j as (select feature, bin, y, count(*) as n_by from b group by all),
p as (select *, sum(n_by) over (partition by feature) as n, sum(n_by) over (partition by feature, bin) as n_b,
        sum(n_by) over (partition by feature, y) as n_y from j),
mi as (select feature, round(sum((n_by / n) * ln(n_by * n / (n_b * n_y))), 8) as mi from p group by feature)
select feature, mi, cast(row_number() over (order by mi desc, feature) as int) as rank from mi""")
def q_mi_rank(spark, sf):
    return XS.mi_rank(_cases(spark, sf), NUM, "target_bin", 10)


_MI_SQL_BODY = None


def _corr_rank(spark, sf):
    tc = A.target_corr(_encoded(spark, sf), NUM, ["y_bin"])
    from pyspark.sql import Window
    return tc.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "feature")))


_CONS_SQL = f"""
, lab as (select * from cases_raw where target_bin is not null),
lv as ({' union all '.join(f"select '{c}' as feature, {c} as value, target_bin as y from lab where {c} is not null" for c in NUM)}),
ed as (select feature, quantile_cont(value, [{_EDGES}]) as edges from lv group by feature),
b as (select lv.feature, lv.y, len(list_filter(ed.edges, lambda e: e < lv.value)) as bin from lv join ed on lv.feature = ed.feature),
j as (select feature, bin, y, count(*) as n_by from b group by all),
p as (select *, sum(n_by) over (partition by feature) as n, sum(n_by) over (partition by feature, bin) as n_b,
        sum(n_by) over (partition by feature, y) as n_y from j),
mi as (select feature, round(sum((n_by / n) * ln(n_by * n / (n_b * n_y))), 8) as mi from p group by feature),
mir as (select feature, row_number() over (order by mi desc, feature) as rank from mi),
cod as (select *, case target_bin {' '.join(f"when '{v}' then {i}" for i, v in enumerate(BIN_CLASSES))} end as y_bin from cases_raw),
tc as (select feature, round(c, 8) as corr from ({' union all '.join(f"select '{c}' as feature, corr({c}, y_bin) as c from cod" for c in NUM)}) t
       where c is not null and not isnan(c)),
tcr as (select feature, row_number() over (order by abs(corr) desc, feature) as rank from tc)
"""


@query("consensus", W("cases_raw") + _CONS_SQL + """
select feature from mir where rank <= 3 intersect select feature from tcr where rank <= 3""")
def q_consensus(spark, sf):
    mi = XS.mi_rank(_cases(spark, sf), NUM, "target_bin", 10)
    return XS.consensus([mi, _corr_rank(spark, sf)], 3)


@query("selection_summary", W("cases_raw") + _CONS_SQL + """
, sel as (select 'target_bin' as target, 'mi' as method, feature from mir where rank <= 3
          union all select 'target_bin', 'corr', feature from tcr where rank <= 3)
select target, method, cast(count(*) as bigint) as n_features, list_sort(list(feature)) as features
from sel group by target, method""")
def q_selection_summary(spark, sf):
    mi = XS.mi_rank(_cases(spark, sf), NUM, "target_bin", 10).where("rank <= 3")
    cr = _corr_rank(spark, sf).where("rank <= 3")
    sel = (mi.select(F.lit("target_bin").alias("target"), F.lit("mi").alias("method"), "feature")
           .unionByName(cr.select(F.lit("target_bin").alias("target"), F.lit("corr").alias("method"), "feature")))
    return XS.selection_summary(sel)


@query("chained_impute")
def q_chained_impute(spark, sf):
    """I4 on the numeric case columns, 20 rounds at most (rows-only check; NumPy-checked in tests)."""
    df = _cases(spark, sf).select("row_id", *NUM)
    out, _ = ChainedImputer(NUM, max_iter=20, tol=1e-3).fit_transform(df)
    return out.select("row_id", *[_r(c) for c in NUM])


# --------------------------------------------------------------------------- I3
def _knn_impute_sql(cols: list[str], sources: list[str], k: int = 5) -> str:
    """Brute force over every (recipient, train row) pair: the oracle only.

    Recipients are flagged on the fixture's own columns in the encoding scan
    (an encoded column is null exactly when its source is); filtering the
    encoded view on its nulls trips an internal DuckDB dictionary-cache fault."""
    from .q_prepare import split_sql
    p = len(cols)
    both = lambda c: f"r.{c} is not null and t.{c} is not null"
    sumsq = " + ".join(["0.0"] + [f"(case when {both(c)} then (r.{c} - t.{c}) * (r.{c} - t.{c}) else 0.0 end)"
                                  for c in cols])
    nc = " + ".join(f"(case when {both(c)} then 1 else 0 end)" for c in cols)
    flagged = ENCODE_CASES_SQL.replace(
        " from cases_raw", f", ({' or '.join(f'{c} is null' for c in sources)}) as miss from cases_raw")
    sql = W("cases_raw") + split_sql("target_bin") + f"""
, enc as ({flagged}),
x as (select e.*, s.split = 'train' as is_train from enc e join split_rows s on e.row_id = s.row_id),
tr as (select row_id, {', '.join(cols)} from x where is_train),
rec as (select row_id, {', '.join(cols)} from enc where miss),
pr0 as (select r.row_id as rid, t.row_id as tid, {sumsq} as ss, {nc} as nc,
          {', '.join(f'r.{c} is null as m{j}, t.{c} as v{j}' for j, c in enumerate(cols))}
        from rec r, tr t),
pr as (select *, cast({p} as double) * ss / cast(nc as double) as d2 from pr0 where nc > 0),
"""
    for j in range(p):
        sql += (f"i{j} as (select rid, avg(v) as v from (select rid, v{j} as v, row_number() over "
                f"(partition by rid order by d2, tid) as rk from pr where m{j} and v{j} is not null) z "
                f"where rk <= {k} group by rid),\n")
    sql += "mu as (select " + ", ".join(f"avg({c}) as {c}" for c in cols) + " from tr)\n"
    sql += ("select x.row_id, " + ", ".join(f"round(coalesce(x.{c}, i{j}.v, mu.{c}), 8) as {c}"
                                           for j, c in enumerate(cols))
            + " from x, mu " + " ".join(f"left join i{j} on x.row_id = i{j}.rid" for j in range(p)))
    return sql


@query("knn_impute", _knn_impute_sql(ENCODED, NUM + ["segment", "line_status"]))
def q_knn_impute(spark, sf):
    """Fit on the stratified train split, impute every labelled row (train and test)."""
    from pyspark import StorageLevel

    from ..operators import split as T
    from ..operators.knn_impute import KnnImputer
    from .cases import SEED, TEST_FRAC
    s = T.stratified_split(_cases(spark, sf).select("row_id", "target_bin"), "target_bin", TEST_FRAC, SEED)
    x = (_encoded(spark, sf).select("row_id", *ENCODED).join(s.select("row_id", "split"), "row_id")
         .persist(StorageLevel.MEMORY_AND_DISK))
    out = KnnImputer(ENCODED, k=5).fit(x.where(F.col("split") == "train")).transform(x)
    return out.select("row_id", *[_r(c) for c in ENCODED])

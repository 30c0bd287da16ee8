"""Registered queries: scoring prompts with a pluggable scorer.

The scorer here is the deterministic stand-in of ``operators.scorers``, whose
reply is a function of one feature of the new case, so SQL can say it; a
deployment passes its own model client."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier as C
from ..operators import encode as E
from ..operators import features as FT
from ..operators import prompts as G
from ..operators import scorers as S
from ..operators import split as T
from ..operators.binning import dealt
from ..session import stored
from ..sources import fixtures as X
from .cases import FEATURES, SEED, TEST_FRAC
from .q_prepare import split_sql
from .registry import query

W = X.with_clause


def _labelled(spark, sf):
    """(row_id, features, label, y_multi, split), written once: fit, refresh and
    prediction read it a dozen times, and the ranks of the split cost several shuffles."""
    df = X.cases_raw(spark, sf)
    enc = E.fit_targets(df, ["target_bin", "target_multi"])
    lab = df.select("row_id", *FEATURES, enc.code("target_bin").alias("label"),
                    enc.code("target_multi").alias("y_multi"))
    # dealt evenly: the ranks of the split leave a class's rows in one task
    return stored(dealt(T.stratified_split(lab, "label", TEST_FRAC, SEED), df.count()), "labelled")


_NAMES = {0: "high", 1: "low"}


@query("score_rows", W("cases_raw") + """
select row_id, cast(null as varchar) as error, case when total_price is null then 'unsure' else
    (case when cast(trunc(total_price) as bigint) % 2 = 1
          then '<think>total_price is ' || cast(cast(total_price as double) as varchar) || '</think> ' else '' end)
    || (case when total_price > 250000 then '0' else '1' end) end as reply
from cases_raw""")
def q_score_rows(spark, sf):
    df = X.cases_raw(spark, sf)
    clf = C.PromptClassifier(S.threshold_scorer("total_price", 250000.0), FEATURES, "target_bin", _NAMES)
    clf.classes, clf.majority = [0, 1], 1
    return G.score_rows(clf.prompts(df), clf.scorer, partitions=spark.sparkContext.defaultParallelism)


@query("prompt_classifier", W("cases_raw") + split_sql("target_bin") + """
, coded as (select row_id, split, cast(case label when 'high' then 0 else 1 end as int) as label from split_rows),
most as (select label from coded where split = 'train' group by label order by count(*) desc, label limit 1)
select c.row_id, c.label, cast(null as varchar) as error,
  cast(case when r.total_price is null then (select label from most) when r.total_price > 250000 then 0 else 1 end as int) as prediction
from coded c join cases_raw r on c.row_id = r.row_id where c.split = 'test'""")
def q_prompt_classifier(spark, sf):
    s = _labelled(spark, sf)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    clf = C.PromptClassifier(S.threshold_scorer("total_price", 250000.0), FEATURES, "target_bin", _NAMES,
                             shots=2, max_total=6, refine_rounds=1, refine_subset=100).fit(train)
    return clf.predict(test).join(test.select("row_id", "label"), "row_id")


@query("refresh_examples")
def q_refresh_examples(spark, sf):
    s = _labelled(spark, sf).where("split = 'train'")
    clf = C.PromptClassifier(S.threshold_scorer("acct_bal", 0.0), FEATURES, "target_bin", _NAMES,
                             shots=2, max_total=6, refine_rounds=2, refine_subset=100).fit(s)
    return clf.example_rows(spark).select("label", F.col("rank").alias("slot"), "case_text")


@query("risk_features", W("cases_raw") + split_sql("target_bin") + """
, f as (select r.row_id, s.split, r.total_price, cast(case when r.total_price > 250000 then 1 else 0 end as double) as y
        from split_rows s join cases_raw r on s.row_id = r.row_id)
select row_id, split, total_price, y as y_diagnosis, 1 - y as y_severity, y as y_management from f""")
def q_risk_features(spark, sf):
    s = _labelled(spark, sf)
    train = s.where("split = 'train'")
    rs = C.RiskScorer(S.risk_scorer("total_price", 250000.0), FEATURES, ["label", "y_multi"],
                      {"label": _NAMES, "y_multi": {0: "F", 1: "O", 2: "P"}}).fit(train)
    risks = rs.transform(s)
    return FT.append_features(s.select("row_id", "split", "total_price"), risks)

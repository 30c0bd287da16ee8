"""Registered queries: prototypes, prompt text, reply parsing, committee and
routing (G1-G12, G16-G18, L12, L21, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import encode as E
from ..operators import features as FT
from ..operators import neighbours as N
from ..operators import prompts as G
from ..operators.block_search import nearest_rows
from ..sources import fixtures as X
from .cases import FEATURES, MULTI_CLASSES, NUM
from .q_prepare import split_sql
from .registry import query

W = X.with_clause


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _num_sql(c: str) -> str:
    return f"cast(cast({c} as double) as varchar)"


def _case_text_sql(cols=FEATURES) -> str:
    parts = []
    for c in cols:
        v = _num_sql(c) if c in NUM else f"cast({c} as varchar)"
        parts.append(f"'{c} = ' || coalesce({v}, 'missing')")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


# --------------------------------------------------------------------------- G2, G3
@query("class_prototypes", W("emb_raw") + """
, e as (select row_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from emb_raw),
c as (select label, i, avg(cast(embedding[i] as double)) as m from e group by label, i),
d as (select e.row_id, e.label, round(sqrt(sum((cast(e.embedding[e.i] as double) - c.m) * (cast(e.embedding[e.i] as double) - c.m))), 6) as dist
      from e join c on e.label = c.label and e.i = c.i group by e.row_id, e.label),
r as (select label, cast(row_number() over (partition by label order by dist, row_id) as int) as rank, row_id, dist from d)
select * from r where rank <= 3""")
def q_class_prototypes(spark, sf):
    return N.class_prototypes_vec(X.emb_raw(spark, sf), "label", "embedding", 3, dim=64)


@query("cap_examples", W("emb_raw") + """
, e as (select row_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from emb_raw),
c as (select label, i, avg(cast(embedding[i] as double)) as m from e group by label, i),
d as (select e.row_id, e.label, round(sqrt(sum((cast(e.embedding[e.i] as double) - c.m) * (cast(e.embedding[e.i] as double) - c.m))), 6) as dist
      from e join c on e.label = c.label and e.i = c.i group by e.row_id, e.label),
r as (select label, cast(row_number() over (partition by label order by dist, row_id) as int) as rank, row_id, dist from d)
select * from r where rank <= 3 order by label, rank limit 20""")
def q_cap_examples(spark, sf):
    p = N.class_prototypes_vec(X.emb_raw(spark, sf), "label", "embedding", 3, dim=64)
    return N.cap_examples(p, 20)


_PROTO_CASES_SQL = f"""
, lab as (select * from cases_raw where target_multi is not null),
mf as (select {', '.join(f'avg({c}) as a_{c}' for c in NUM)} from lab),
fl as (select row_id, target_multi, {', '.join(f'coalesce({c}, a_{c}) as {c}' for c in NUM)} from lab, mf),
ce as (select target_multi, {', '.join(f'avg({c}) as c_{c}' for c in NUM)} from fl group by target_multi),
d as (select fl.row_id, fl.target_multi, round(sqrt({' + '.join(f'(fl.{c} - ce.c_{c}) * (fl.{c} - ce.c_{c})' for c in NUM)}), 6) as dist
      from fl join ce on fl.target_multi = ce.target_multi),
r as (select target_multi, cast(row_number() over (partition by target_multi order by dist, row_id) as int) as rank, row_id, dist from d)
"""


@query("case_prototypes", W("cases_raw") + _PROTO_CASES_SQL + f"""
select r.target_multi, r.rank, r.row_id, r.dist, {', '.join(f'c.{x}' for x in NUM)}
from r join cases_raw c on r.row_id = c.row_id where r.rank <= 2""")
def q_case_prototypes(spark, sf):
    return N.class_prototypes(X.cases_raw(spark, sf), "target_multi", NUM, 2)


# --------------------------------------------------------------------------- G1, G4-G7
@query("case_text", W("cases_raw") + f"select row_id, {_case_text_sql()} as case_text from cases_raw")
def q_case_text(spark, sf):
    return G.case_text(X.cases_raw(spark, sf), FEATURES).select("row_id", "case_text")


@query("legend_text", W("cases_raw") + """
, m as (select 'target_multi' as target, target_multi as label from cases_raw where target_multi is not null
        union select 'target_bin', target_bin from cases_raw where target_bin is not null),
c as (select target, dense_rank() over (partition by target order by label) - 1 as code, label from m)
select target, string_agg(cast(code as varchar) || ' = ' || label, chr(10) order by code) as legend from c group by target""")
def q_legend_text(spark, sf):
    return G.legend_text(E.label_map(X.cases_raw(spark, sf), ["target_multi", "target_bin"]))


@query("example_text", W("cases_raw") + _PROTO_CASES_SQL + f"""
, ex as (select r.rank, cast(case r.target_multi {' '.join(f"when '{v}' then {i}" for i, v in enumerate(MULTI_CLASSES))} end as int) as label,
           r.target_multi as label_name, {_case_text_sql()} as case_text
         from r join cases_raw on r.row_id = cases_raw.row_id where r.rank <= 2),
blocks as (select 'Example ' || cast(row_number() over (order by label, rank, label_name, case_text) as varchar) || ':' || chr(10)
             || 'Features: ' || case_text || chr(10) || 'Correct label for target_multi: ' || cast(label as varchar)
             || ' (' || label_name || ')' || chr(10) as b, label, rank, label_name, case_text from ex)
select {_q(G.EXAMPLES_HEADER)} || string_agg(b, chr(10) order by label, rank, label_name, case_text) || chr(10) as examples_text
from blocks""")
def q_example_text(spark, sf):
    df = X.cases_raw(spark, sf)
    protos = N.class_prototypes(df, "target_multi", NUM, 2)
    lm = E.label_map(df, ["target_multi"]).where(F.col("target") == "target_multi")
    ex = (G.case_text(protos.join(df.select("row_id", "segment", "line_status"), "row_id"), FEATURES)
          .join(lm.select(F.col("label").alias("target_multi"), F.col("code").alias("label")), "target_multi")
          .select("label", "rank", F.col("target_multi").alias("label_name"), "case_text"))
    return G.example_text(ex, "target_multi")


_EVID_SRC = """
, ev as (select row_id, model || '_' || features as model, prediction as pred_id,
           case when prediction = 1 then 'high' else 'low' end as label_name,
           case when prediction = 1 then score else 1.0 - score end as probability
         from run_predictions where split = 'test')"""


def _evidence_df(spark, sf):
    p = X.run_predictions(spark, sf).where(F.col("split") == "test")
    return p.select("row_id", F.concat_ws("_", "model", "features").alias("model"),
                    F.col("prediction").alias("pred_id"),
                    F.when(F.col("prediction") == 1, "high").otherwise("low").alias("label_name"),
                    F.when(F.col("prediction") == 1, F.col("score")).otherwise(1.0 - F.col("score")).alias("probability"))


@query("evidence_text", W("run_predictions") + _EVID_SRC + f"""
select row_id, {_q(G.EVIDENCE_HEADER)} || string_agg('- ' || model || ': predicted ' || cast(pred_id as varchar) || ' ('
  || label_name || '), probability = ' || printf('%.3f', probability), chr(10) order by model) || chr(10) as evidence_text
from ev group by row_id""")
def q_evidence_text(spark, sf):
    return G.evidence_text(_evidence_df(spark, sf))


_LEGEND_BIN = "0 = high\n1 = low"
_ROLE = G.ROLE_TEXT.format(target="target_bin")
_PROMPT_HEAD = f"\n{_ROLE}\n\n{G.MAPPING_INTRO}\n\n{_LEGEND_BIN}\n\n"
_PROMPT_MID = f"\n\n{G.NEW_CASE}"
_PROMPT_TAIL = "\n\n" + G.ALLOWED.format(ids="0, 1") + G.ANSWER.format(ids="0, 1")


def _prompts_df(spark, sf):
    df = X.cases_raw(spark, sf)
    lm = E.label_map(df, ["target_bin"])
    legend = G.legend_text(lm).first()["legend"]  # one short string per target
    classes = [r["code"] for r in lm.orderBy("code").collect()]
    ct = G.case_text(df, FEATURES)
    return G.build_prompts(ct, "target_bin", legend, classes).select("row_id", "prompt")


_PROMPT_SQL = f"({_q(_PROMPT_HEAD)} || '' || {_q(_PROMPT_MID)} || {_case_text_sql()} || {_q(_PROMPT_TAIL)})"


@query("build_prompts", W("cases_raw") + f"select row_id, {_PROMPT_SQL} as prompt from cases_raw")
def q_build_prompts(spark, sf):
    return _prompts_df(spark, sf)


@query("prompts_with_evidence", W("cases_raw", "run_predictions") + _EVID_SRC + f"""
, et as (select row_id, {_q(G.EVIDENCE_HEADER)} || string_agg('- ' || model || ': predicted ' || cast(pred_id as varchar) || ' ('
  || label_name || '), probability = ' || printf('%.3f', probability), chr(10) order by model) || chr(10) as evidence_text
  from ev group by row_id)
select c.row_id, {_q(_PROMPT_HEAD)} || coalesce(et.evidence_text, '') || {_q(_PROMPT_MID)} || {_case_text_sql()} || {_q(_PROMPT_TAIL)} as prompt
from cases_raw c left join et on c.row_id = et.row_id""")
def q_prompts_with_evidence(spark, sf):
    df = X.cases_raw(spark, sf)
    ev = G.evidence_text(_evidence_df(spark, sf))
    ct = G.case_text(df, FEATURES).join(ev, "row_id", "left")
    return G.build_prompts(ct, "target_bin", _LEGEND_BIN, [0, 1], evidence_col="evidence_text").select("row_id", "prompt")


@query("request_json", W("cases_raw") + f"""
select row_id, to_json({{'model': 'chat-model', 'messages': [{{'role': 'system', 'content': ''}}, {{'role': 'user', 'content': {_PROMPT_SQL}}}], 'stream': false}}) as body
from cases_raw""")
def q_request_json(spark, sf):
    p = _prompts_df(spark, sf)
    return p.select("row_id", TX.request_json(F.col("prompt"), "chat-model").alias("body"))


# --------------------------------------------------------------------------- G8-G12
@query("reply_text", W("replies") + """
select row_id, coalesce(json_extract_string(to_json({'message': {'content': reply}}), '$.message.content'), '') as ollama,
  json_extract_string(to_json({'choices': [{'message': {'content': reply}}]}), '$.choices[0].message.content') as openai
from replies""")
def q_reply_text(spark, sf):
    r = X.replies(spark, sf)
    oll = F.to_json(F.struct(F.struct(F.col("reply").alias("content")).alias("message")))
    oai = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices")))
    return r.select("row_id", TX.reply_text(oll, "ollama").alias("ollama"), TX.reply_text(oai, "openai").alias("openai"))


_STRIP_SQL = """
, st as (select row_id, reply, strpos(reply, '<think>') as s from replies),
en as (select *, case when s > 0 then coalesce(nullif(strpos(substr(reply, s + 7), '</think>'), 0) + s + 6, 0) else 0 end as e from st),
cl as (select row_id, regexp_replace(case when s > 0 and e > 0 then substr(reply, 1, s - 1) || substr(reply, e + 8) else reply end,
         '^\\s+|\\s+$', '', 'g') as clean from en)"""


@query("strip_think", W("replies") + _STRIP_SQL + " select row_id, clean from cl")
def q_strip_think(spark, sf):
    return X.replies(spark, sf).select("row_id", TX.strip_think(F.col("reply")).alias("clean"))


_MAJ_SQL = "(select label from pred_multi group by label order by count(*) desc, label limit 1)"


@query("parse_label", W("replies", "pred_multi") + _STRIP_SQL + f"""
, pr as (select row_id, clean, try_cast(nullif(regexp_extract(regexp_replace(clean, '^\\s+|\\s+$', '', 'g'), '-?\\d+', 0), '') as bigint) as v from cl)
select row_id, clean, cast(case when clean is not null and v in (0, 1, 2) then v else {_MAJ_SQL} end as int) as parsed from pr""")
def q_parse_label(spark, sf):
    default = G.majority_class(X.pred_multi(spark, sf), "label").first()["label"]
    return G.parse_replies(X.replies(spark, sf), "reply", [0, 1, 2], default).select("row_id", "clean", "parsed")


def _flag_sql(name):
    return (f"case when try_cast(nullif(regexp_extract(flags, '{name}\\s*=\\s*(\\d+)', 1), '') as decimal(38,0)) >= 1 "
            f"then 1.0 else 0.0 end as {name}")


_FLAGS_SQL = ", ".join(_flag_sql(n) for n in G.FLAG_NAMES)


@query("parse_flags", W("replies") + f"select row_id, {_FLAGS_SQL} from replies")
def q_parse_flags(spark, sf):
    return G.parse_flags(X.replies(spark, sf), "flags").select("row_id", *G.FLAG_NAMES)


@query("majority_class", W("pred_multi") + """
select label, cast(count(*) as bigint) as n from pred_multi group by label order by n desc, label limit 1""")
def q_majority_class(spark, sf):
    return G.majority_class(X.pred_multi(spark, sf), "label")


@query("append_features", W("cases_raw", "replies") + f"""
select c.row_id, c.total_price, f.y_diagnosis, f.y_severity, f.y_management
from cases_raw c left join (select row_id, {_FLAGS_SQL} from replies) f on c.row_id = f.row_id""")
def q_append_features(spark, sf):
    risks = G.parse_flags(X.replies(spark, sf), "flags").select("row_id", *G.FLAG_NAMES)
    return FT.append_features(X.cases_raw(spark, sf).select("row_id", "total_price"), risks)


# --------------------------------------------------------------------------- L12, L21, G16-G18
@query("one_hot_scores", W("pred_multi") + """
select row_id, prediction, case when prediction = 0 then 1.0 else 0.0 end as p0,
  case when prediction = 1 then 1.0 else 0.0 end as p1, case when prediction = 2 then 1.0 else 0.0 end as p2
from pred_multi""")
def q_one_hot_scores(spark, sf):
    return G.one_hot_scores(X.pred_multi(spark, sf).select("row_id", "prediction"), 3)


def _members(spark, sf):
    """Committee of three probability sources over pred_multi rows."""
    pm = X.pred_multi(spark, sf)
    a = pm.select("row_id", F.lit("probs").alias("model"), F.array("p0", "p1", "p2").alias("probs"))
    oh = G.one_hot_scores(pm.select("row_id", "prediction"), 3)
    b = oh.select("row_id", F.lit("onehot").alias("model"), F.array("p0", "p1", "p2").alias("probs"))
    flat = pm.select("row_id", F.lit("flat").alias("model"),
                     F.array(*[(F.col(f"p{c}") * 0.5 + F.lit(1.0 / 6.0)) for c in range(3)]).alias("probs"))
    return a.unionByName(b).unionByName(flat)


_MEMBERS_SQL = """
, mem as (select row_id, 'probs' as model, p0, p1, p2 from pred_multi
          union all select row_id, 'onehot', case when prediction = 0 then 1.0 else 0.0 end,
            case when prediction = 1 then 1.0 else 0.0 end, case when prediction = 2 then 1.0 else 0.0 end from pred_multi
          union all select row_id, 'flat', p0 * 0.5 + 1.0 / 6.0, p1 * 0.5 + 1.0 / 6.0, p2 * 0.5 + 1.0 / 6.0 from pred_multi)"""


@query("soft_vote", W("pred_multi") + _MEMBERS_SQL + """
, a as (select row_id, avg(p0) as p0, avg(p1) as p1, avg(p2) as p2 from mem group by row_id)
select row_id, round(p0, 10) as p0, round(p1, 10) as p1, round(p2, 10) as p2,
  case when p1 > p0 and p2 <= p1 then 1 when p2 > greatest(p0, p1) then 2 else 0 end as prediction from a""")
def q_soft_vote(spark, sf):
    return G.soft_vote(_members(spark, sf), 3)


_UNC_SQL = """
, unc as (select row_id, round(1 - avg(greatest(p0, p1, p2)), 10) as uncertainty from mem group by row_id)"""


@query("uncertainty", W("pred_multi") + _MEMBERS_SQL + _UNC_SQL + " select * from unc")
def q_uncertainty(spark, sf):
    return G.uncertainty(_members(spark, sf))


@query("boundary_threshold", W("pred_multi") + _MEMBERS_SQL + _UNC_SQL +
       " select round(quantile_cont(uncertainty, 0.8), 10) as threshold from unc")
def q_boundary_threshold(spark, sf):
    return G.boundary_threshold(G.uncertainty(_members(spark, sf)), 0.2)


@query("route", W("pred_multi", "replies") + _MEMBERS_SQL + _UNC_SQL + _STRIP_SQL + f"""
, thr as (select quantile_cont(uncertainty, 0.8) as t from unc),
pr as (select row_id, try_cast(nullif(regexp_extract(regexp_replace(clean, '^\\s+|\\s+$', '', 'g'), '-?\\d+', 0), '') as bigint) as v, clean from cl),
alt as (select row_id, cast(case when clean is not null and v in (0, 1, 2) then v else {_MAJ_SQL} end as int) as a from pr),
j as (select b.row_id, b.prediction, b.p0, b.p1, b.p2, u.uncertainty, alt.a,
        coalesce(u.uncertainty > (select round(t, 10) from thr) and alt.a is not null, false) as routed
      from pred_multi b left join unc u on b.row_id = u.row_id left join alt on b.row_id = alt.row_id)
select row_id, case when routed then a else prediction end as prediction, routed,
  {', '.join(f'round(case when routed then (case when a = {c} then 0.999 else 0.001 end) else p{c} end, 10) as p{c}' for c in range(3))}
from j""")
def q_route(spark, sf):
    unc = G.uncertainty(_members(spark, sf))
    thr = G.boundary_threshold(unc, 0.2).first()["threshold"]  # one number (fit output)
    default = G.majority_class(X.pred_multi(spark, sf), "label").first()["label"]
    alt = G.parse_replies(X.replies(spark, sf), "reply", [0, 1, 2], default).select(
        "row_id", F.col("parsed").alias("prediction"))
    out = G.route(X.pred_multi(spark, sf), alt, unc, thr, 3)
    return out.select("row_id", "prediction", F.coalesce("routed", F.lit(False)).alias("routed"),
                      *[F.round(f"p{c}", 10).alias(f"p{c}") for c in range(3)])


# --------------------------------------------------------------------------- L9
@query("knn_classify", W("emb_raw") + split_sql("label", src="emb_raw") + """
, s as (select e.row_id, e.label, cast(e.embedding as double[]) as v, sr.split
        from emb_raw e join split_rows sr on e.row_id = sr.row_id),
d as (select q.row_id, t.row_id as tid, t.label as y, round(list_distance(q.v, t.v), 9) as dist
      from s q, s t where q.split = 'test' and t.split = 'train'),
top as (select * from (select *, row_number() over (partition by row_id order by dist, tid) as rk from d) x where rk <= 5),
votes as (select row_id, y, count(*) as votes from top group by row_id, y)
select row_id, y as prediction, cast(votes as bigint) as votes from (
  select *, row_number() over (partition by row_id order by votes desc, y) as r from votes) z where r = 1""")
def q_knn_classify(spark, sf):
    from ..operators import split as T
    e = X.emb_raw(spark, sf)
    s = T.stratified_split(e.select("row_id", "label"), "label", 0.2, 42)
    e = e.join(s.select("row_id", "split"), "row_id")
    train = e.where("split = 'train'").select("row_id", "label", F.col("embedding").alias("vec"))
    test = e.where("split = 'test'").select("row_id", F.col("embedding").alias("vec"))
    return N.knn_classify(train, test, 5, "vec", "label")


# --------------------------------------------------------------------------- L18 (neighbour count)
# fixed values: the neighbour counts the reference sweeps (odd numbers 1 to 21)
KNN_K_RANGE = [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21]


@query("sweep_knn_k", W("emb_raw") + split_sql("label", src="emb_raw") + f"""
, s as (select e.row_id, e.label, cast(e.embedding as double[]) as v, sr.split
        from emb_raw e join split_rows sr on e.row_id = sr.row_id),
d as (select q.row_id, q.label as truth, t.row_id as tid, t.label as y, round(list_distance(q.v, t.v), 9) as dist
      from s q, s t where q.split = 'test' and t.split = 'train'),
top as (select * from (select *, row_number() over (partition by row_id order by dist, tid) as rk from d) x
        where rk <= {max(KNN_K_RANGE)}),
ks as (select unnest({KNN_K_RANGE}) as k),
votes as (select ks.k, row_id, truth, y, count(*) as votes from top join ks on top.rk <= ks.k
          group by ks.k, row_id, truth, y),
pred as (select * from (select *, row_number() over (partition by k, row_id order by votes desc, y) as r
                        from votes) z where r = 1),
acc as (select k, avg(case when y = truth then 1.0 else 0.0 end) as a from pred group by k)
select cast(k as int) as n_neighbors, round(a, 10) as test_accuracy,
  k = (select min(k) from acc where a = (select max(a) from acc)) as best
from acc""")
def q_sweep_knn_k(spark, sf):
    from ..operators import split as T
    e = X.emb_raw(spark, sf)
    s = T.stratified_split(e.select("row_id", "label"), "label", 0.2, 42)
    e = e.join(s.select("row_id", "split"), "row_id")
    train = e.where("split = 'train'").select("row_id", "label", F.col("embedding").alias("vec"))
    test = e.where("split = 'test'").select("row_id", "label", F.col("embedding").alias("vec"))
    nb = nearest_rows(train, test.select("row_id", "vec"), max(KNN_K_RANGE), "vec", "label")
    return N.knn_sweep(nb, test, KNN_K_RANGE)

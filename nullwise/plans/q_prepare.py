"""Registered queries: profiling, projections, encoding, splitting (M, P, E, S6, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as P
from ..operators import encode as E
from ..operators import missing as M
from ..operators import split as T
from ..sources import fixtures as X
from .cases import (BIN_CLASSES, CAT, FEATURES, LINE_STATUS, MULTI_CLASSES, NUM, PROFILE, SEED,
                    SEGMENTS, TARGETS, TEST_FRAC)
from .registry import query

W = X.with_clause


def _cases(spark, sf):
    return X.cases_raw(spark, sf)


# --------------------------------------------------------------------------- M
def _sql_profile(cols):
    parts = " union all ".join(
        f"select '{c}' as feature, count(*) - count({c}) as n_missing, count(*) as n from cases_raw"
        for c in cols)
    return parts


@query("missing_profile", W("cases_raw") + f"""
select feature, cast(n_missing as bigint) as n_missing,
  round(cast(n_missing as double) * 100.0 / cast(n as double), 6) as pct_missing
from ({_sql_profile(PROFILE)}) t""")
def q_missing_profile(spark, sf):
    return M.missing_profile(_cases(spark, sf), PROFILE)


@query("missing_report", W("cases_raw") + f"""
select feature, cast(n_missing as bigint) as n_missing,
  round(cast(n_missing as double) * 100.0 / cast(n as double), 6) as pct_missing
from ({_sql_profile(PROFILE)}) t where n_missing > 0
order by pct_missing desc, feature""")
def q_missing_report(spark, sf):
    return M.missing_report(_cases(spark, sf), PROFILE)


@query("missing_total", W("cases_raw") + f"""
select cast(count(*) as bigint) as n_rows, cast({len(PROFILE)} as bigint) as n_cols,
  cast(count(*) * {len(PROFILE)} as bigint) as n_cells,
  cast({' + '.join(f'(count(*) - count({c}))' for c in PROFILE)} as bigint) as n_missing,
  round(cast({' + '.join(f'(count(*) - count({c}))' for c in PROFILE)} as double) * 100.0
        / cast(count(*) * {len(PROFILE)} as double), 6) as pct_missing
from cases_raw""")
def q_missing_total(spark, sf):
    return M.missing_total(_cases(spark, sf), PROFILE)


@query("missing_matrix", W("cases_raw") + " union all ".join(
    f"select row_id, '{c}' as feature, cast({c} is null as int) as is_missing from cases_raw"
    for c in PROFILE))
def q_missing_matrix(spark, sf):
    return M.missing_matrix(_cases(spark, sf), PROFILE)


@query("missing_patterns", W("cases_raw") + f"""
select concat({', '.join(f"cast(cast({c} is null as int) as varchar)" for c in PROFILE)}) as pattern,
  cast(count(*) as bigint) as n_rows
from cases_raw group by 1""")
def q_missing_patterns(spark, sf):
    return M.missing_patterns(_cases(spark, sf), PROFILE)


_WITH_MISSING = ["n_lines", "sum_qty", "avg_disc", "segment", "line_status", "target_bin"]


@query("missing_indicators", W("cases_raw") + f"""
select row_id, {', '.join(f'cast({c} is null as double) as {c}_missing' for c in _WITH_MISSING)}
from cases_raw""")
def q_missing_indicators(spark, sf):
    df = _cases(spark, sf)
    cols = M.columns_with_missing(df, PROFILE)
    return M.missing_indicators(df, cols)


def _target_codes_sql():
    multi = " ".join(f"when '{v}' then {i}" for i, v in enumerate(MULTI_CLASSES))
    binc = " ".join(f"when '{v}' then {i}" for i, v in enumerate(BIN_CLASSES))
    return (f"case target_multi {multi} end as y_multi, case target_bin {binc} end as y_bin")


@query("missing_target_corr", W("cases_raw") + f"""
, coded as (select *, {_target_codes_sql()} from cases_raw)
select feature, target, round(corr, 8) as corr from (
  {' union all '.join(
      f"select '{c}' as feature, '{t}' as target, corr(cast({c} is null as double), cast({t} as double)) as corr from coded"
      for c in _WITH_MISSING for t in ('y_multi', 'y_bin'))}
) t where corr is not null and not isnan(corr)""")
def q_missing_target_corr(spark, sf):
    df = _cases(spark, sf)
    enc = E.fit_targets(df, TARGETS)
    coded = df.withColumn("y_multi", enc.code("target_multi")).withColumn("y_bin", enc.code("target_bin"))
    cols = M.columns_with_missing(df, PROFILE)
    return M.missing_target_corr(coded, cols, ["y_multi", "y_bin"])


# --------------------------------------------------------------------------- P
@query("drop_all_null", W("cases_raw") + """
select row_id, total_price, acct_bal, n_lines, sum_qty, avg_disc, segment, line_status,
  target_multi, target_bin
from cases_raw""")
def q_drop_all_null(spark, sf):
    # note_text is free text (P1); an all-null column appears through the
    # left join for orders without line items and is dropped by P4
    df = P.drop_columns(_cases(spark, sf), ["note_text"])
    df = df.withColumn("empty_col", F.when(F.col("n_lines") < 0, F.lit(1.0)))
    return P.drop_all_null(df)


@query("variant_columns", W("cases_raw") + """
select row_id, total_price, n_lines, sum_qty, segment, target_multi, target_bin from cases_raw""")
def q_variant_columns(spark, sf):
    df = P.drop_columns(_cases(spark, sf), ["note_text"])
    family = ["acct_bal", "avg_disc", "line_status"]  # a column family and a leaky column
    return P.variant(df, family + ["not_there"])


@query("require_label", W("cases_raw") + """
select row_id, total_price, target_bin from cases_raw where target_bin is not null""")
def q_require_label(spark, sf):
    return P.require_label(_cases(spark, sf).select("row_id", "total_price", "target_bin"), "target_bin")


@query("keep_classes", W("cases_raw") + """
select row_id, target_multi from cases_raw
where target_multi in (select target_multi from cases_raw where target_bin = 'high')""")
def q_keep_classes(spark, sf):
    df = _cases(spark, sf)
    classes = df.where(F.col("target_bin") == "high").select("target_multi")
    return P.keep_classes(df.select("row_id", "target_multi"), "target_multi", classes)


# --------------------------------------------------------------------------- E
def _onehot_sql(col, values):
    return ", ".join(
        f"case when {col} is null then null else cast({col} = '{v}' as double) end as {col}_{v}"
        for v in values)


def _binary_sql(col, values):
    return (f"case when {col} is null then null when {col} = '{values[0]}' then 0.0 "
            f"when {col} = '{values[1]}' then 1.0 end as {col}")


@query("encode_binary", W("cases_raw") + f"select row_id, {_binary_sql('line_status', LINE_STATUS)} from cases_raw")
def q_encode_binary(spark, sf):
    df = _cases(spark, sf).select("row_id", "line_status")
    return E.fit_encoding(df, ["line_status"]).transform(df)


@query("encode_onehot", W("cases_raw") + f"select row_id, {_onehot_sql('segment', SEGMENTS)} from cases_raw")
def q_encode_onehot(spark, sf):
    df = _cases(spark, sf).select("row_id", "segment")
    return E.fit_encoding(df, ["segment"]).transform(df)


ENCODE_CASES_SQL = (f"select row_id, {', '.join(f'cast({c} as double) as {c}' for c in NUM)}, "
                    f"{_onehot_sql('segment', SEGMENTS)}, {_binary_sql('line_status', LINE_STATUS)} "
                    f"from cases_raw")


@query("encode_cases", W("cases_raw") + ENCODE_CASES_SQL)
def q_encode_cases(spark, sf):
    df = P.drop_columns(_cases(spark, sf), ["note_text"])
    return E.fit_encoding(df, FEATURES).transform(df)


TARGET_SQL = (f"select row_id, cast(case target_multi "
              f"{' '.join(f'when {chr(39)}{v}{chr(39)} then {i}' for i, v in enumerate(MULTI_CLASSES))} end as int)"
              f" as target_multi, cast(case target_bin "
              f"{' '.join(f'when {chr(39)}{v}{chr(39)} then {i}' for i, v in enumerate(BIN_CLASSES))} end as int)"
              f" as target_bin from cases_raw")


@query("encode_targets", W("cases_raw") + TARGET_SQL)
def q_encode_targets(spark, sf):
    df = _cases(spark, sf)
    return E.fit_targets(df, TARGETS).transform(df)


@query("label_map", W("cases_raw") + """
select target, cast(dense_rank() over (partition by target order by label) - 1 as int) as code, label
from (select distinct 'target_multi' as target, target_multi as label from cases_raw where target_multi is not null
      union all
      select distinct 'target_bin', target_bin from cases_raw where target_bin is not null) t""")
def q_label_map(spark, sf):
    return E.label_map(_cases(spark, sf), TARGETS)


@query("id_to_label", W("cases_raw") + """
, m as (select cast(dense_rank() over (order by label) - 1 as int) as code, label
        from (select distinct target_multi as label from cases_raw) t)
select c.row_id, c.code, coalesce(m.label, concat('class_', cast(c.code as varchar))) as label_name
from (select row_id, cast(row_id % 5 as int) as code from cases_raw) c left join m on c.code = m.code""")
def q_id_to_label(spark, sf):
    df = _cases(spark, sf)
    codes = df.select("row_id", (F.col("row_id") % 5).cast("int").alias("code"))
    return E.id_to_label(codes, E.label_map(df, ["target_multi"]), "target_multi", "code")


# docs_raw: class = language/source; train = doc_id not divisible by 5
_DOCS_CLASS = "concat(lang, '/', source)"


@query("compact_labels", W("docs_raw") + f"""
, d as (select row_id, {_DOCS_CLASS} as cls, case when row_id % 5 = 0 then 'test' else 'train' end as split from docs_raw),
codes as (select cls, cast(dense_rank() over (order by cls) - 1 as int) as code
          from (select distinct cls from d where split = 'train') t)
select d.row_id, d.split, codes.code as label from d join codes on d.cls = codes.cls""")
def q_compact_labels(spark, sf):
    d = X.docs_raw(spark, sf).select(
        "row_id", F.concat("lang", F.lit("/"), "source").alias("cls"),
        F.when(F.col("row_id") % 5 == 0, "test").otherwise("train").alias("split"))
    tr, te = E.compact_labels(d.where("split = 'train'"), d.where("split = 'test'"), "cls", "label")
    return tr.unionByName(te).select("row_id", "split", "label")


@query("drop_rare_classes", W("docs_raw") + f"""
, d as (select row_id, {_DOCS_CLASS} as cls, case when row_id % 5 = 0 then 'test' else 'train' end as split from docs_raw),
keep as (select cls from d where split = 'train' group by cls having count(*) >= 5),
codes as (select cls, cast(dense_rank() over (order by cls) - 1 as int) as code from keep)
select d.row_id, d.split, codes.code as label from d join codes on d.cls = codes.cls""")
def q_drop_rare_classes(spark, sf):
    d = X.docs_raw(spark, sf).select(
        "row_id", F.concat("lang", F.lit("/"), "source").alias("cls"),
        F.when(F.col("row_id") % 5 == 0, "test").otherwise("train").alias("split"))
    tr, te = T.drop_rare_classes(d.where("split = 'train'"), d.where("split = 'test'"), "cls", 5, "label")
    return tr.unionByName(te).select("row_id", "split", "label")


@query("encoding_log", W("cases_raw") + """
, agg as (select count(*) as n, """ + ", ".join(f"count({c}) as c_{c}" for c in FEATURES) + """,
            list_sort(list(distinct segment) filter (where segment is not null)) as segs,
            list_sort(list(distinct line_status) filter (where line_status is not null)) as lss from cases_raw),
logrows as (""" + " union all ".join(
    f"select '{c}' as feature, 'numeric' as kind, n - c_{c} as n_missing, n, '' as mapping from agg" for c in NUM) + """
  union all select 'segment', 'onehot', n - c_segment, n,
    array_to_string(list_transform(segs, lambda v: 'segment_' || v), ', ') from agg
  union all select 'line_status', 'binary', n - c_line_status, n, lss[1] || '=0; ' || lss[2] || '=1' from agg)
select feature, kind, cast(n_missing as bigint) as n_missing,
  round(cast(n_missing as double) * 100.0 / cast(n as double), 6) as pct_missing, mapping from logrows""")
def q_encoding_log(spark, sf):
    return E.encoding_log(_cases(spark, sf), FEATURES)


# --------------------------------------------------------------------------- T
def split_sql(label: str, frac: float = TEST_FRAC, seed: int = SEED, src: str = "cases_raw") -> str:
    """CTEs ``lab``, ``quota`` and ``split_rows``(row_id, label, split) for the oracle."""
    return f"""
, lab as (select row_id, {label} as label, substr(md5(concat('{seed}|', cast(row_id as varchar))), 1, 15) as h
          from {src} where {label} is not null),
cnt as (select label, count(*) as n from lab group by label),
base as (select label, n, cast(floor(n * cast({frac} as double)) as bigint) as b,
           n * cast({frac} as double) - floor(n * cast({frac} as double)) as rem from cnt),
tot as (select cast(ceil(sum(n) * cast({frac} as double)) as bigint) - sum(b) as extra from base),
quota as (select label, b + case when row_number() over (order by rem desc, label asc) <= (select extra from tot)
                            then 1 else 0 end as quota from base),
split_rows as (select lab.row_id, lab.label,
    case when row_number() over (partition by lab.label order by lab.h, lab.row_id) - 1 < quota.quota
         then 'test' else 'train' end as split
  from lab join quota on lab.label = quota.label)
"""


@query("stratified_split", W("cases_raw") + split_sql("target_bin") +
       "select row_id, label as target_bin, split from split_rows")
def q_stratified_split(spark, sf):
    df = _cases(spark, sf).select("row_id", "target_bin")
    return T.stratified_split(df, "target_bin", TEST_FRAC, SEED)


@query("assign_folds", W("cases_raw") + f"""
, lab as (select row_id, target_multi, substr(md5(concat('{SEED}|', cast(row_id as varchar))), 1, 15) as h
          from cases_raw where target_multi is not null)
select row_id, target_multi,
  cast((row_number() over (partition by target_multi order by h, row_id) - 1) % 5 as int) as fold
from lab""")
def q_assign_folds(spark, sf):
    df = _cases(spark, sf).select("row_id", "target_multi")
    return T.assign_folds(df, "target_multi", 5, SEED)


@query("hash_sample", W("cases_raw") + f"""
select row_id, total_price, segment from cases_raw
order by substr(md5(concat('{SEED}|', cast(row_id as varchar))), 1, 15), row_id limit 100""")
def q_hash_sample(spark, sf):
    df = _cases(spark, sf).select("row_id", "total_price", "segment")
    return T.hash_sample(df, 100, SEED)


@query("class_quotas", W("cases_raw") + split_sql("target_multi") + """
select label as target_multi, cast(sum(case when split = 'test' then 1 else 0 end) as bigint) as n_test,
  cast(count(*) as bigint) as n from split_rows group by label""")
def q_class_quotas(spark, sf):
    df = _cases(spark, sf).select("row_id", "target_multi")
    s = T.stratified_split(df, "target_multi", TEST_FRAC, SEED)
    return s.groupBy("target_multi").agg(
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).cast("long").alias("n_test"),
        F.count(F.lit(1)).cast("long").alias("n"))

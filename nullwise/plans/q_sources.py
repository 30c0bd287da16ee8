"""Registered queries: sources and sinks by round trip (S1-S5), column choices (P3, P6, P7, P10, P12),
one split for two variants (T2), appended scores (F4), concatenated runs (A11)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import columns as P
from ..operators import explore as A
from ..operators import models as L
from ..operators import split as T
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources import io as S
from ..sources.tables import table
from .cases import NUM, SEED, TARGETS, TEST_FRAC
from .q_models import prepared
from .q_prepare import split_sql
from .registry import query

W = X.with_clause


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("read_cases", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def q_read_cases(spark, sf):
    """The raw table with a given schema, which prunes the scan."""
    return S.read_cases(spark, os.path.join(sf, "orders.parquet"), "o_orderkey long, o_totalprice double, o_orderstatus string")


@query("load_dictionary", """
select trim(o_orderpriority) as variable, trim(arg_max(concat(' ', o_orderstatus, cast(o_orderkey as varchar), ' '), o_orderkey)) as explanation
from orders where o_orderkey % 3 <> 0 group by 1""")
def q_load_dictionary(spark, sf):
    """Padded names, blank ones (a third of the rows), every name listed many times."""
    key = F.col("o_orderkey").cast("string")
    raw = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("Variable name"),
        F.concat(F.lit(" "), "o_orderstatus", key, F.lit(" ")).alias("EXPLANATION (text)"), "o_orderkey")
    return S.load_dictionary(raw, "o_orderkey")


@query("split_round_trip", W("cases_raw") + split_sql("target_bin") +
       "select c.row_id, c.total_price, c.segment, s.label as target_bin, s.split "
       "from cases_raw c join split_rows s on c.row_id = s.row_id where s.split = 'test'")
def q_split_round_trip(spark, sf):
    """Both splits written as one partitioned table, the test split read back."""
    cases = X.cases_raw(spark, sf).select("row_id", "total_price", "segment", "target_bin")
    path = _folder(spark, "split")
    S.write_split(T.stratified_split(cases, "target_bin", TEST_FRAC, SEED), path)
    return S.read_split(spark, path, "test").select("row_id", "total_price", "segment", "target_bin", "split")


@query("results_round_trip", W("cases_raw") + """
select target_multi, cast(count(*) as bigint) as n,
  concat('["', min(segment), '","', max(segment), '"]') as segments
from cases_raw where target_multi is not null group by target_multi""")
def q_results_round_trip(spark, sf):
    """A result table with an array column, written as CSV and read back."""
    cases = X.cases_raw(spark, sf).where(F.col("target_multi").isNotNull())
    result = cases.groupBy("target_multi").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("segment"), F.max("segment")).alias("segments"))
    path = _folder(spark, "results")
    S.write_results(result, path)
    return spark.read.option("header", True).option("escape", "\\").schema("target_multi string, n long, segments string").csv(path)


@query("feature_columns", W("cases_raw") +
       "select row_id, total_price, acct_bal, n_lines, sum_qty, avg_disc, segment, line_status, note_text from cases_raw")
def q_feature_columns(spark, sf):
    """Everything but the targets."""
    df = X.cases_raw(spark, sf)
    return df.select("row_id", *P.feature_columns(df, TARGETS))


@query("numeric_columns", W("cases_raw") + f"select row_id, {', '.join(NUM)} from cases_raw")
def q_numeric_columns(spark, sf):
    """Numeric columns only."""
    df = X.cases_raw(spark, sf)
    return df.select("row_id", *P.numeric_columns(df, exclude=["row_id"]))


@query("existing_columns", W("cases_raw") + "select row_id, sum_qty, segment from cases_raw")
def q_existing_columns(spark, sf):
    """The part of a wish list that exists, projected."""
    df = X.cases_raw(spark, sf)
    return P.project_features(df, P.existing(df, ["sum_qty", "not_there", "segment"]))


@query("tagged_runs", W("cases_raw") + """
select 'target_bin' as target, 'full' as features, target_bin as class, cast(count(*) as bigint) as n, cast(null as double) as price
from cases_raw where target_bin is not null group by target_bin
union all select 'target_multi', 'price', target_multi, cast(count(*) as bigint), round(sum(total_price), 2)
from cases_raw where target_multi is not null group by target_multi""")
def q_tagged_runs(spark, sf):
    """Tables of two targets tagged and concatenated; a column that one lacks is null there."""
    df = X.cases_raw(spark, sf)
    one = df.where("target_bin is not null").groupBy(F.col("target_bin").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    two = df.where("target_multi is not null").groupBy(F.col("target_multi").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("total_price"), 2).alias("price"))
    both = A.union_runs([P.tag(one, target="target_bin", features="full"), P.tag(two, target="target_multi", features="price")])
    return both.select("target", "features", "class", "n", "price")


@query("split_variants", W("cases_raw") + split_sql("target_bin") + """
select 'full' as variant, s.split, cast(count(*) as bigint) as n, cast(count(sum_qty) as bigint) as n_qty, round(avg(total_price), 6) as mean_price
from cases_raw c join split_rows s on c.row_id = s.row_id group by s.split
union all select 'no_lines', s.split, cast(count(*) as bigint), null, round(avg(total_price), 6)
from cases_raw c join split_rows s on c.row_id = s.row_id group by s.split""")
def q_split_variants(spark, sf):
    """The split is computed once; both variants are projections of it."""
    split = T.stratified_split(X.cases_raw(spark, sf).select("row_id", "total_price", "sum_qty", "n_lines", "target_bin"), "target_bin", TEST_FRAC, SEED)
    less = P.variant(split, ["n_lines", "sum_qty"])
    runs = []
    for name, d in (("full", split), ("no_lines", less)):
        qty = F.count("sum_qty") if "sum_qty" in d.columns else F.lit(None).cast("long")
        runs.append(d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), qty.alias("n_qty"), F.round(F.avg("total_price"), 6).alias("mean_price"))
                    .select(F.lit(name).alias("variant"), "split", "n", "n_qty", "mean_price"))
    return A.union_runs(runs)


@query("append_scores")
def q_append_scores(spark, sf):
    """a forest's class probabilities appended to the feature vector (rows-only check)."""
    from pyspark.ml.functions import vector_to_array
    train, test, _ = prepared(spark, sf)
    scored = L.append_scores(test, L.forest(train, "label", 20), "forest", out="stacked")
    return scored.select("row_id", "label", vector_to_array("stacked").alias("stacked"))

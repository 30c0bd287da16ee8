"""Every registered query with an oracle equals DuckDB on sf0.001 (the driver
runs the same comparison at sf0.01); the rest must at least run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from nullwise.sources.tables import TABLES
from tools.check_oracle import rows_of

from .conftest import MEDIUM, SMALL

ORACLE = entry.oracle_sql()
HEAVY = {"forward_select", "fit_stack_linear", "fit_neural_forest", "fit_rbf", "boundary_hybrid",
         "fit_boosted", "fit_hist_boosted", "fit_adaboost", "model_metrics", "fit_boosted_multi",
         "fit_stack_refine", "fit_extra_trees", "fit_forest", "fit_l1_logistic", "sweep_tree_depth",
         "importance_rank", "l1_rank", "chained_impute", "compare_imputers", "fit_spline_logistic",
         "backward_select", "forward_backward", "fit_hist_boosted_l2", "fit_adaboost_shares", "sweep_forest_trees",
         "sweep_boosting_rounds", "fit_soft_vote_depths", "sweep_logistic_c", "sweep_kernel_c"}


def _duck(sf, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    res = c.execute(sql)
    return [d[0] for d in res.description], res.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    sf = SMALL
    try:
        d_cols, d_rows = _duck(sf, ORACLE[name])
    except duckdb.InternalException:
        # DuckDB 2.0 trips an internal dictionary-cache assertion on a few of
        # these texts over the tiny sf0.001 files; compare at sf0.01 instead
        sf = MEDIUM
        d_cols, d_rows = _duck(sf, ORACLE[name])
    df = entry.queries()[name](spark, sf)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in ORACLE and n not in HEAVY))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"split", "accuracy", "auc"}
    assert df.count() == 2

"""A spread of registered queries against their SQL; check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normal

SPREAD = [
    "p6_alias_names", "p9_guarded_ratios", "j2_left_variant", "a3_period_summary", "a5_corr_matrix", "a11_histogram", "a16_mode",
    "w5_pareto_customers", "w9_group_means", "u8_long_to_wide", "i13_focus_summary", "i14_scope_recompute", "m5_forecast_run_short_series",
    "m9_cusum_break", "m17_tail_score_customers", "q3_psi_quantile", "q4_chi_square", "v10_contract_quarantine", "p21_scenario_presets", "x3_stream_rollup",
]


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", SPREAD)
def test_query_equals_sql(spark, duck, data_dir, key):
    got = contract.queries()[key](spark, data_dir).toPandas()
    assert normal(got) == normal(duck.execute(contract.oracle_sql()[key]).df())


def test_entry_returns_rows(spark):
    assert 0 < contract.entry(spark).count() <= 12


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

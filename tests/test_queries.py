"""Queries against their SQL on the smallest tables, and the driver's contract."""

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from shockwell.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["s8_sparse_candles", "c5_calendar_gaps", "v1_variance_proxies", "v5_ewma_volatility", "v8_proxy_disagreement", "t8_deciles", "h8_innovations", "e1_volatility_shocks", "r2_median_counterfactual", "r17_aftershock_excess", "h12_moment_shocks", "h16_market_moments", "h9_mobility_fits", "d1_curves", "st1_streamed_candles",
          "s4_payload_rows", "s8_paged_candles", "s9_archive_members", "s10_market_data", "k1_daily_export", "j1_last_event", "j3_recent_order", "q1_sketched_thresholds", "h8_online_scores", "r1_mean_counterfactual", "r9_local_projections", "t13_regression_by_period", "p5_error_bars",
          "r5_matched_controls", "h13_matched_paths", "d6_relaxation_predictions", "d11_omori_probability", "p11_horizon_table", "p14_record_text"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_is_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    own = sorted(plain(r) for r in df.select(*columns).collect())
    assert own == sorted(plain([r[names.index(c)] for c in columns]) for r in want.fetchall())


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.HERE, timeout=120).returncode == 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

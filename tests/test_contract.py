"""A cross-section of the registered queries against their SQL at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from contract.check import TABLES, compare

SF = "/root/testdata/sf0.001"
PICKED = [
    "a2_load_panel", "a9_date_from_path", "b6_date_range", "c2_windows", "c4_refit_schedule", "c5_training_rows",
    "d3_moving_average", "e3_percentile", "e7_mean_curves_wide", "h11_all_metrics", "h15_describe", "i5_normal_qq",
    "c7_continued_backtest", "e9_curve_fit", "f6_evidence_ridge", "f14_fixed_evidence", "g1_fixed_predictions", "g6_result_rows", "h5_ks_two_sample",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).fetchdf()) == "ok"


def test_every_oracle_has_a_query_and_parses(con):
    assert set(oracle_sql()) <= set(queries())
    for sql in oracle_sql().values():
        con.execute(f"explain {sql}")


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0

"""Queries return a row for every day, ticker and pair that their tables hold."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators import signals
from tidemark.plans.catalog import QUERIES
from tidemark.sources.panel import panel, read


@pytest.mark.parametrize("name", ["mom_returns", "mom_log_trimmed", "mom_log_ewma", "sig_volume", "sig_consistency", "join_as_of_earnings", "prep_split_adjust", "sim_switch_equity", "risk_restarting_year"])
def test_a_row_for_every_day(spark, name):
    assert QUERIES[name](spark, SMALL).count() == panel(spark, SMALL).count()


def test_no_volume_factor_without_a_slope(spark):
    assert [r[0] for r in spark.sql("SELECT explode(array(0.0D, NULL)) s").select(signals.volume_factor(F.col("s"))).collect()] == [1.0, None]


def test_joins_of_every_supplier_and_nation(spark, tmp_path):
    rows = [(1, 7), (1, 7), (30, 7), (30, 8), (40, 8), (41, 9)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.a, r.b, r.common, r.share) for r in QUERIES["join_fund_overlap"](spark, str(tmp_path)).collect()}
    assert got == {(1, 30, 1, 1.0), (30, 40, 1, 1.0)}
    keys = QUERIES["join_left"](spark, SMALL).select("c_custkey").distinct().count()
    assert keys == read(spark, SMALL, "customer").count()


def test_regimes_of_every_year(spark):
    rows = QUERIES["model_hmm_regimes"](spark, SMALL).collect()
    assert rows and {r.state for r in rows} <= {0, 1, 2} and {(r.t - 504) % 252 for r in rows} == {0}

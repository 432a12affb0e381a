"""Plans that stay small, and forms that hold for tables of many rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import both
from tests.conftest import SMALL
from tidemark.operators import simulation
from tidemark.plans.catalog import ORACLE_SQL, QUERIES
from tidemark.plans.registry import sql6


def test_plan_of_chained_folds_is_small(spark):
    """Its text is built on the driver again and again; frames persisted over each other made it a product."""
    frame = QUERIES["sim_oos_aggregate"](spark, SMALL)
    assert "InMemoryRelation" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert len(frame._jdf.queryExecution().toString()) < 500_000


def test_first_near_day_against_every_day():
    rng = random.Random(5)
    for n in (1, 2, 3, 40):
        for _ in range(20):
            first = {round(rng.uniform(90, 130), rng.choice([0, 1])): d for d in rng.sample(range(1, 999), n)}
            closes = sorted(first)
            costs = [*(round(rng.uniform(80, 140), 1) for _ in range(60)), *(c / 0.95 for c in closes), *(c / 1.05 for c in closes), 0.0, -5.0, 1e18, float("nan"), float("inf")]
            got = simulation.first_near(np.array(closes), np.array([first[c] for c in closes]), np.array(costs), 0.05)
            for x, day in zip(costs, got):
                near = [first[c] for c in closes if x > 0 and abs(c / x - 1) <= 0.05]
                nearest = [first[c] for c in closes if abs(c - x) == min(abs(z - x) for z in closes)] if np.isfinite(x) else list(first.values())
                assert day == min(near or nearest)


def test_positions_do_not_meet_every_day(spark, monkeypatch):
    """They meet the sorted closes of their ticker, in parts."""
    monkeypatch.setattr(simulation, "ENTRY_PART", 7)
    panel = spark.createDataFrame([("a", d, 100.0 + d % 50) for d in range(1, 400)] + [("b", 1, 7.0)], "ticker string, t int, close double")
    held = spark.createDataFrame([(i, "ab"[i % 2], None if i == 4 else 90.0 + i) for i in range(60)] + [(60, "none", 1.0)], "id long, ticker string, cost double")
    frame = simulation.entry_days(held, panel)
    want = {}
    for i in range(60):
        if i % 2:
            want[i] = 1
        else:
            near = [d for d in range(1, 400) if i != 4 and abs((100.0 + d % 50) / (90.0 + i) - 1) <= 0.05]
            want[i] = min(near) if near else 1 if i == 4 else min(range(1, 400), key=lambda d: (abs(10.0 + d % 50 - i), d))
    assert {r.id: r.entry for r in frame.collect()} == want


def test_rounding_as_sql_rounds(spark):
    values = [k / 1e6 - 0.25 for k in range(50, 650_000, 1300)] + [k / 1e8 for k in range(50, 90_000, 100)] + [0.0, -0.5, 1e12 + 0.1234565]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (4, 6):
        got = [r[0] for r in frame.select(sql6(F.col("x"), digits)).collect()]
        assert got == [duckdb.execute("SELECT round(?::DOUBLE, ?)", [v, digits]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["report_no_blowup", "sweep_targets", "report_dd_tiers", "agg_quartile_frequency"])
def test_returns_on_a_half_are_rounded_as_in_sql(spark, tmp_path, name):
    """An order a customer and year, its price such that the return's sixth decimal is a 5 and its fifth and fourth vary."""
    rows = [(i, i // 3, 1000.0 * (i % 640) + 100 * (i % 10) + 50 + 1000 * (i % 7), f"{1992 + i % 3}-03-01") for i in range(6000)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    frame.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "to_timestamp(o_orderdate) o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    ours, theirs, a, b = both(spark, QUERIES[name], ORACLE_SQL[name], str(tmp_path), con)
    assert a == b and ours == theirs

"""Hand-checked cases and properties of the operators that SQL can't express."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import functions
from tidemark.operators import allocation, hmm, momentum, montecarlo, prep, risk, signals, simulation


def frame(spark, closes, ticker="A"):
    rows = [(ticker, i + 1, float(c) if c is not None else None) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, t int, close double")


def test_drawdown_ulcer_and_pain(spark):
    rows = frame(spark, [100, 110, 99, 121, 90.75]).withColumn("dd", risk.drawdown())
    assert [round(r.dd, 6) for r in rows.orderBy("t").collect()] == [0, 0, -0.1, 0, -0.25]
    s = risk.curve_summary(frame(spark, [100, 110, 99, 121, 90.75]), ["ticker"], "close").first()
    assert round(s.ulcer, 6) == 0.120416 and round(s.pain, 6) == 0.07


def test_constant_series(spark):
    rows = frame(spark, [5.0] * 30).withColumn("ret", momentum.simple_return())
    assert rows.withColumn("r2", signals.trend_r2(20)).orderBy(F.desc("t")).first().r2 == 0.0
    assert risk.correlations(rows.withColumn("date", F.col("t"))).first()["corr"] is None


def test_water_fill_modes(spark):
    rows = spark.createDataFrame([("g", "a", 4.0, 40.0), ("g", "b", 2.0, 40.0), ("g", "c", 1.0, 40.0)], "g string, ticker string, weight double, cap double")
    for capital, want in ((110, [40, 40, 30]), (100, [40, 40, 20]), (500, [40, 40, 40])):
        got = allocation.water_fill(rows, ["g"], capital).orderBy("ticker").collect()
        assert [round(r["alloc"], 4) for r in got] == want
    weights, caps = {"a": 4.0, "b": 2.0, "c": 1.0}, dict.fromkeys("abc", 40.0)
    assert [round(v, 4) for v in allocation.rounds_fill(weights, caps, 110).values()] == [40, 40, 23.3333]


def test_switch_and_equity(spark):
    rows = spark.createDataFrame([("A", i + 1, c, n) for i, (c, n) in enumerate(zip([0.0, -3.0, 1.0, 5.0], [10.0, 8.0, 8.8, 11.0]))], "ticker string, t int, chg double, close double")
    out = rows.withColumn("signal", simulation.switch(F.col("chg"), -2.0, 4.0)).withColumn("e", simulation.equity_under()).orderBy("t").collect()
    assert [r.signal for r in out] == ["MOMENTUM", "CASH", "CASH", "MOMENTUM"]
    assert [round(r.e) for r in out] == [1000, 800, 800, 800]


def test_split_factor_and_adjustment(spark):
    raw = spark.createDataFrame([(4.7,), (1.35,), (7.0,)], "x double")
    assert [r[0] for r in raw.select(prep.snap_factor(F.col("x"))).collect()] == [5.0, 1.5, 7.0]
    bars = spark.sql("SELECT 'A' ticker, date_add(DATE'2020-01-01', CAST(id AS INT)) date, IF(id < 2, 100.0D, 50.0D) close FROM range(3)")
    actions = spark.sql("SELECT 'A' ticker, DATE'2020-01-03' ex_date, 2.0D factor")
    assert [round(r.adj_close, 6) for r in prep.split_adjusted(bars, actions).orderBy("date").collect()] == [50, 50, 50]


@pytest.mark.parametrize(("months", "want"), [(12, 1.0), (24, 0.4), (36, 0.03), (40, 0.03)])
def test_underwater_penalty(spark, months, want):
    assert spark.range(1).select(risk.underwater_penalty(F.lit(months))).first()[0] == pytest.approx(want)


def test_nerve_penalty(spark):
    assert spark.range(1).select(risk.nerve_penalty(F.lit(0.5), F.lit(12))).first()[0] == pytest.approx(0.5)


def test_engine_never_looks_ahead():
    rng = np.random.default_rng(1)
    p = np.cumprod(1 + rng.normal(0, 0.02, (400, 5)), 0) * 100
    s = rng.random((400, 5))
    whole = simulation.walk(p, s, 2, 21, 60, 0.1, 10, 0.2, 0.03)
    assert np.allclose(whole[:300], simulation.walk(p[:300], s[:300], 2, 21, 60, 0.1, 10, 0.2, 0.03))


def test_hmm_likelihood_grows_and_orders_by_vol():
    rng = np.random.default_rng(2)
    vol = np.repeat([0.01, 0.04, 0.01, 0.04], 200)
    x = np.column_stack([rng.normal(0, vol), vol + rng.normal(0, 0.002, 800)])
    model = hmm.fit(x, 2)
    assert all(b >= a - 1e-6 for a, b in zip(model["likelihood"], model["likelihood"][1:]))
    assert model["mean"][0, 1] > model["mean"][1, 1] and hmm.predict(model, x) == 0
    assert hmm.fit(x[:100]) is None and hmm.predict(None, x) == -1


def test_paths_do_not_depend_on_partitions(spark):
    history = spark.range(300).select(F.col("id").alias("i"), ((F.col("id") % 7 - 3) / 1000.0).alias("r"))
    a = sorted(map(tuple, montecarlo.block_paths(history, 20, 42, 21, 3).collect()))
    b = sorted(map(tuple, montecarlo.block_paths(history.repartition(7), 20, 42, 21, 3).collect()))
    assert a == b and len(a) == 20 * 42


def test_black_scholes_parity(spark):
    args = [F.lit(x) for x in (100.0, 95.0, 0.5, 0.03, 0.25)]
    put, call = spark.range(1).select(functions.black_scholes(*args), functions.black_scholes(*args, kind="call")).first()
    assert call - put == pytest.approx(100 - 95 * np.exp(-0.015), abs=1e-4)

"""The aligned panel: tickers meet on dates, whatever days each misses."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import engines, momentum, prep, risk, scoring, signals, simulation
from tidemark.sources.panel import aligned

START = datetime.date(2020, 1, 1)


def rows_of(spark, closes):
    """closes: ticker -> {day: close}; volume 1, no dividend."""
    rows = [(t, START + datetime.timedelta(d), float(c), 1.0, float(c), 0.0, n + 1) for t, days in closes.items() for n, (d, c) in enumerate(sorted(days.items()))]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double, dvol double, dividend double, t int")


def series(spark, closes):
    return spark.createDataFrame([("A", i + 1, float(c)) for i, c in enumerate(closes)], "ticker string, t int, close double").withColumn("ret", momentum.simple_return()).withColumn("lret", momentum.log_return())


def test_two_tickers_missing_different_days(spark):
    got = aligned(rows_of(spark, {"A": {0: 10, 1: 11, 3: 13}, "B": {1: 20, 2: 21, 3: 22}})).orderBy("ticker", "t").collect()
    a, b = ([(r.t, r.close, r.n, r.traded) for r in got if r.ticker == t] for t in "AB")
    assert a == [(1, 10, 1, True), (2, 11, 2, True), (3, 11, 2, False), (4, 13, 3, True)]
    assert b == [(2, 20, 1, True), (3, 21, 2, True), (4, 22, 3, True)]
    assert all(len({r.date for r in got if r.t == t}) == 1 for t in (1, 2, 3, 4)) and [r.volume for r in got if r.ticker == "A"] == [1, 1, 0, 1]


def test_acceleration_by_definition(spark):
    p = np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.05, 200)))
    got = series(spark, p).withColumn("m", momentum.acceleration()).where("t = 200").first().m
    end, mid, start = p[200 - 21 - 1], p[200 - 21 - 126 + 63], p[200 - 21 - 126]
    assert got == pytest.approx(np.log(end / start) + 0.5 * (np.log(end / mid) - np.log(mid / start)))


def test_consistency_by_definition(spark):
    p = np.exp(np.cumsum(np.random.default_rng(4).normal(0.004, 0.05, 500)))
    got = {r.t: r.ok for r in series(spark, p).withColumn("ok", signals.consistent()).collect()}
    for n in range(1, 501):
        ups = sum(p[n - 21 - 21 * m] > p[n - 42 - 21 * m] for m in range(1, 12)) if n >= 273 else None
        assert got[n] == (True if ups is None else ups >= 8)


def test_worst_window_by_every_window(spark):
    p = np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.05, 150)))
    every = [p[i : i + 63] for i in range(150 - 63)]
    want = min((w / np.maximum.accumulate(w) - 1).min() for w in every)
    rows = series(spark, p).withColumn("d", risk.depth_in(63)).where("t < 150")
    assert rows.agg(F.min("d")).first()[0] == pytest.approx(want)


def test_scorer_against_plain_numpy(spark):
    rng = np.random.default_rng(6)
    p = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.03, 400)))
    panel = series(spark, p).withColumn("dvol", F.col("close") * 1000)
    got = scoring.score_table(panel, panel.where("t = 400").select("ticker", "t")).first()
    r = p[1:] / p[:-1] - 1
    mom = {lb: p[400 - 22] / p[400 - 21 - lb] - 1 for lb in (21, 63, 126, 252)}
    blend = 0.2 * mom[63] + 0.4 * mom[126] + 0.4 * mom[252]
    window, x = np.log(p[400 - 273 : 400 - 21]), np.arange(252)
    slope, cut = np.polyfit(x, window, 1)
    r2 = 1 - ((window - slope * x - cut) ** 2).sum() / ((window - window.mean()) ** 2).sum()
    fip = (r[400 - 273 : 400 - 21] > 0).mean()
    last = p[-252:]
    ulcer = np.sqrt(((last / np.maximum.accumulate(last) - 1) ** 2).mean())
    depth = p / np.maximum.accumulate(p) - 1
    runs, now = [], 0
    for d in depth:
        if d < 0:
            now += 1
        elif now:
            runs, now = [*runs, now], 0
    runs += [now] if now else []
    want = {"wt_mom": blend, "quality": r2, "fip": fip, "dn_vol": r[r < 0].std() * 252**0.5, "ulcer_1y": ulcer, "martin": blend / ulcer, "max_dd": depth.min(), "max_dd_dur": max(runs), "avg_dd_dur": np.mean(runs), "current_dd": depth[-1], "latest_price": p[-1]}
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name
    dv = np.polyfit(np.arange(63), np.log(1000 * p[-63:]), 1)[0] * 252
    assert got.dv_slope == pytest.approx(dv) and got.score_sortino == pytest.approx(blend * np.sqrt(r2 * fip) / want["dn_vol"] * np.clip(1 + 0.15 * dv, 0.7, 1.3) * got.high_factor)
    assert scoring.score_table(panel, panel.where("t = 83").select("ticker", "t")).count() == 0


def test_missing_price_keeps_its_value():
    p = np.array([[10.0], [10.0], [np.nan], [12.0], [12.0]])
    got = simulation.walk(p, np.ones_like(p), 1, 10, 1, 0.5, 5, 0.0, 0.0)
    assert np.allclose(got, [1, 1, 1, 1.2, 1.2])


def test_fixed_steps_engine():
    days, tickers = np.arange(10, 22), ["A", "B"]
    prices = np.column_stack([np.linspace(100, 111, 12), np.full(12, 50.0)])
    config = {"every": 4, "stop": 0.0, "cool": 5, "target": 0.0, "vol_days": 3, "leverage": 1.0, "cash_rate": 0.0, "gated": False}
    targets = {10: {"A": 0.5, "B": 0.5}, 14: {"B": 1.0}}
    out = engines.fixed_steps(config, days, tickers, prices, np.ones(12, bool), targets, 100.0)
    at = {d: v for d, v in zip(days, out["equity"].to_numpy()[1:])}
    assert at[10] == 100 and at[14] == pytest.approx(50 * 104 / 100 + 50) and at[21] == pytest.approx(at[14])  # all in the flat ticker after day 14
    gated = engines.fixed_steps(config | {"gated": True}, days, tickers, prices, np.arange(12) < 2, targets, 100.0)
    assert gated["equity"].iloc[-1] == pytest.approx(50 * 102 / 100 + 50) and gated["idle"].sum() == 10
    crash = prices.copy()
    crash[3:, 0] = 40.0
    stopped = engines.fixed_steps(config | {"stop": 0.2, "cool": 100}, days, tickers, crash, np.ones(12, bool), targets, 100.0)
    assert stopped["equity"].iloc[-1] == pytest.approx(50 * 40 / 100 + 50)
    levered = engines.fixed_steps(config | {"leverage": 2.0, "cash_rate": 0.10}, days, tickers, prices, np.ones(12, bool), {10: {"A": 1.0}}, 100.0)
    daily = 1.10 ** (1 / 252)
    assert levered["equity"].iloc[2] == pytest.approx(200 * daily * 101 / 100 - 100 * daily * daily)


def test_engines_never_look_ahead():
    rng = np.random.default_rng(1)
    p = np.cumprod(1 + rng.normal(0, 0.02, (200, 3)), 0) * 100
    config = {"every": 21, "stop": 0.1, "cool": 10, "target": 0.2, "vol_days": 20, "leverage": 1.0, "cash_rate": 0.03, "gated": False}
    targets = {d: {"A": 0.3, "B": 0.7} for d in range(0, 200, 21)}
    whole = engines.fixed_steps(config, np.arange(200), list("ABC"), p, np.ones(200, bool), targets)
    part = engines.fixed_steps(config, np.arange(150), list("ABC"), p[:150], np.ones(150, bool), targets)
    assert np.allclose(whole["equity"][:151], part["equity"])


def checked_config(**more):
    return {"check": 10, "min_hold": 20, "max_hold": 40, "jitter": 0, "trigger": "fixed", "gap": 0.1, "stop": 0.0, "regime": False, "target": 0.0, "vol_days": 20, "vol_state": "off", "sizing": "equal", "seed": 1} | more


@pytest.mark.parametrize(("trigger", "age", "scores", "want"), [
    ("fixed", 39, {"A": 1.0, "B": 9.0}, False), ("fixed", 40, {"A": 1.0, "B": 1.0}, True), ("name_change", 19, {"A": 1.0, "B": 2.0}, False), ("name_change", 20, {"A": 1.0, "B": 2.0}, True),
    ("score_gap", 20, {"A": 1.0, "B": 1.09}, False), ("score_gap", 20, {"A": 1.0, "B": 1.11}, True), ("score_gap", 20, {"A": -1.0, "B": 9.0}, False),
])
def test_rebalance_triggers(trigger, age, scores, want):
    assert engines.wants_change(checked_config(trigger=trigger), ["A"], ["B"], scores, age, 0) is want


def test_checked_engine_holds_and_flees():
    days, tickers = np.arange(1, 61), ["A", "C"]
    prices = np.column_stack([1.01 ** np.arange(60), np.full(60, 1.0)])
    scores = {t: {"A": 1.0} for t in days}
    tops = {t: ["A"] for t in days}
    level, calm, one = np.ones(60), np.zeros(60, bool), np.ones(60)
    curve, counts = engines.checked(checked_config(), days, tickers, prices, level, calm, one, scores, tops, 11)
    assert curve["equity"].iloc[-1] == pytest.approx(1.01**50) and counts["changes"] == 2 and counts["mean_hold"] == 40
    below = np.zeros(60, bool)
    below[30:] = True
    fled, _ = engines.checked(checked_config(regime=True), days, tickers, prices, level, below, one, scores, tops, 11)
    assert fled["equity"].iloc[-1] == pytest.approx(1.01**20)
    half, _ = engines.checked(checked_config(), days, tickers, prices, level, calm, np.full(60, 0.5), scores, tops, 11, "C")
    assert half["equity"].iloc[-1] == pytest.approx(1.005**50)


def test_identity_changes_and_nearby_actions(spark):
    day = lambda k: START + datetime.timedelta(k)
    bars = [("A", day(k), c, i) for k, (c, i) in enumerate([(100.0, "x"), (50.0, "y"), (25.0, "z"), (25.5, "w"), (51.0, None), (10.0, "w")])]
    rows = spark.createDataFrame(bars, "ticker string, date date, close double, isin string")
    got = prep.changed_identity(rows)
    assert [(r.ex_date, r.factor) for r in got.orderBy("ex_date").collect()] == [(day(1), 2.0), (day(2), 2.0)]
    none = spark.createDataFrame([], "ticker string, ex_date date, factor double")
    assert [r.ex_date for r in prep.not_near(got, none).collect()] == [day(1)]  # the second is near the first
    known = spark.createDataFrame([("A", day(4), 2.0)], "ticker string, ex_date date, factor double")
    assert prep.not_near(got, known).count() == 0
    adjusted = spark.createDataFrame([("A", day(0), 100.0), ("A", day(3), 20.0), ("A", day(20), 100.0), ("A", day(21), 99.0)], "ticker string, date date, adj_close double")
    assert [(r.ex_date, r.factor) for r in prep.residual_factors(adjusted).collect()] == [(day(3), 5.0)]

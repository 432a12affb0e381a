"""Allocation, taxed rotation, search, readers and sinks against small cases worked out by hand or by plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import functions
from tidemark.operators import allocation, funds, search, simulation, sweep, walkforward
from tidemark.sources import readers, sinks


def poured(weights, caps, capital):
    """The leaky fill, poured step by step."""
    level, left, live = 0.0, capital, dict(weights)
    while live and left > 0.01:
        whole = sum(live.values())
        money = min(left, min(caps[k] / w for k, w in live.items()) * whole)
        level, left = level + money / whole, left - money
        live = {k: w for k, w in live.items() if w * level < caps[k] - 0.01}
    return {k: caps[k] if k not in live else w * level for k, w in weights.items()}


def test_leaky_fill_and_cascade_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(g, f"t{i}", rng.uniform(0.1, 9), rng.uniform(0.5, 2)) for g in range(12) for i in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(rows, "g int, ticker string, score double, wt_mom double").withColumn("weight", F.col("score")).withColumn("cap", F.lit(30.0))
    got = {(r.g, r.ticker): r["alloc"] for r in allocation.leaky_fill(frame, ["g"], 100.0).collect()}
    for g in range(12):
        own = {t: s for k, t, s, _ in rows if k == g}
        for t, v in poured(own, dict.fromkeys(own, 30.0), 100.0).items():
            assert got[g, t] == pytest.approx(v, abs=0.02)
    top, cap, least = 5, 0.3, 0.12
    got = {(r.g, r.ticker): r["alloc"] for r in allocation.cascade(frame, ["g"], 100.0, top, cap, least).collect()}
    for g in range(12):
        names = dict(sorted(((t, s) for k, t, s, _ in rows if k == g), key=lambda x: -x[1])[:top])
        while True:
            given = poured(names, dict.fromkeys(names, 30.0), 100.0)
            if not (small := [t for t, v in given.items() if 0 < v < 12.0]):
                break
            names = {t: s for t, s in names.items() if t not in small}
        assert {t for k, t in got if k == g} == {t for t, v in given.items() if v > 0}
        assert all(got[g, t] == pytest.approx(v, abs=0.02) for t, v in given.items() if v > 0)


def test_cascade_without_positive_scores(spark):
    frame = spark.createDataFrame([(1, "a", -1.0, 1.0), (2, "b", 2.0, -1.0), (3, "c", 2.0, 1.0)], "g int, ticker string, score double, wt_mom double")
    assert [(r.g, r["alloc"]) for r in allocation.cascade(frame, ["g"], 100.0, 5, 0.4, 0.05).collect()] == [(3, 40.0)]


def test_sleeves_demote_the_lowest_of_the_worst(spark):
    rows = [("a1", 9.0, "x"), ("a2", 8.0, "x"), ("a3", 7.0, "x"), ("b1", 6.0, "y"), ("b2", 5.0, "y")]
    frame = spark.createDataFrame([(1, t, s, 1.0, v) for t, s, v in rows], "g int, ticker string, score double, wt_mom double, sleeve string")
    got = {r.ticker: r["alloc"] for r in allocation.sleeve_capped(frame, ["g"], 100.0, 5, 0.3, 0.0, {"x": 0.5}, "equal").collect()}
    assert set(got) == {"a1", "a2", "b1", "b2"} and all(v == pytest.approx(25) for v in got.values())
    assert allocation.sleeve_capped(frame.withColumn("wt_mom", F.lit(-1.0)), ["g"], 100.0, 5, 0.3, 0.0, {"x": 0.5}).count() == 0


def test_overlap_blocks_what_funds_hold(spark):
    scores = spark.createDataFrame([("F", 1.0), ("a", 1.0), ("b", 1.0), ("c", 1.0)], "ticker string, score double")
    alloc = spark.createDataFrame([("F", 10.0)], "ticker string, alloc double")
    overlap = spark.createDataFrame([("F", "a", 0.0), ("F", "b", 0.3), ("F", "c", 0.3), ("G", "c", 0.0)], "fund string, ticker string, threshold double")
    light = spark.createDataFrame([("F", "b", 0.1), ("F", "c", 0.1)], "fund string, ticker string, weight double")
    heavy = light.withColumn("weight", F.lit(0.2))
    assert {r.ticker for r in allocation.without_overlap(alloc, scores, overlap, light).collect()} == {"F", "b", "c"}
    assert {r.ticker for r in allocation.without_overlap(alloc, scores, overlap, heavy).collect()} == {"F"}


def test_haven_takes_what_picks_leave(spark):
    groups = spark.createDataFrame([(1, 4, True, False), (2, 4, True, False), (3, 2, False, True)], "k int, positions int, dual boolean, volscale boolean")
    picks = spark.createDataFrame([(1, "a", 0.1), (3, "a", 0.1), (3, "b", 0.3)], "k int, ticker string, tv double")
    havens = spark.createDataFrame([(k, t, v) for k in (1, 2) for t, v in (("h1", 0.1), ("h2", 0.2))], "k int, ticker string, abs12 double")
    got = {(r.k, r.ticker): round(r.w, 6) for r in allocation.haven_split(picks, havens, groups, ["k"]).collect()}
    assert got == {(1, "a"): 0.25, (1, "h2"): 0.75, (2, "h2"): 1.0, (3, "a"): 0.75, (3, "b"): 0.25}


def test_taxed_spells(spark):
    rows = [(1, 100.0, 200.0, 13, False), (2, 50.0, 60.0, 5, False), (3, 10.0, 9.0, 3, True)]
    spells = spark.createDataFrame([("r", *x) for x in rows], "rule string, spell int, entry double, exit double, months int, open boolean")
    out = funds.taxed(spells, ["rule"], 1_000_000.0).first()
    first = 2_000_000 - 0.125 * (1_000_000 - 125_000)
    second = first * 1.2 - 0.2 * first * 0.2
    assert out.value == pytest.approx(second * 0.9) and out.tax == pytest.approx(0.125 * 875_000 + 0.04 * first) and out.switches == 2


def test_harvest_leaves_a_loser_in_march(spark):
    months = [(f"{2019 + (m // 12)}-{m % 12 + 1:02d}-01", m) for m in range(30)]
    rows = [(t, d, float(c)) for d, m in months for t, c in (("A", 200 - 4 * m), ("B", 100 + m))]
    monthly = spark.createDataFrame(rows, "ticker string, p string, close double").select("ticker", F.to_date("p").alias("period"), "close")
    got = [r.fund for r in funds.harvested(funds.with_momentum(monthly)).orderBy("i").collect()]
    assert got == ["B"] * 18
    falling = monthly.withColumn("close", F.when(F.col("ticker") == "B", 3000 - F.month("period") / 100.0 - F.year("period")).otherwise(F.col("close")))
    path = {r.period.isoformat()[:7]: r.fund for r in funds.harvested(funds.with_momentum(falling)).collect()}
    assert path["2020-02"] != "LIQUID" and path["2020-03"] == "LIQUID" and path["2020-04"] != "LIQUID"


def test_rebalance_cost_and_spells(spark):
    prices = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0), ("b", 2, 5.0)], "ticker string, t int, close double")
    weights = spark.createDataFrame([(1, 1, 0, 1, 2, "a", 1.0), (1, 1, 1, 2, 3, "b", 1.0)], "config_id int, fold int, k int, rt int, until int, ticker string, w double")
    got = {r.k: r.cost for r in walkforward.costs(prices, weights).collect()}
    buy = max(50_000 / 75 * simulation.PER_SHARE, 0.35) / 50_000 + simulation.HALF_SPREAD
    both = max(2 * 50_000 / 75 * simulation.PER_SHARE, 0.7) / 50_000 + 2 * simulation.HALF_SPREAD + simulation.TAX * 1.0
    assert got[0] == pytest.approx(buy) and got[1] == pytest.approx(both)


def test_search_samples_repairs_and_keeps_the_best(spark):
    rng = np.random.default_rng(5)
    for _ in range(300):
        c = search.mutated(search.sampled(rng), rng)
        assert c.min_hold < c.max_hold and (c.states == 0) == (c.profile == "off") == (c.apply == "off")
    log = search.run(lambda batch: [c.positions for c in batch], 60, 7, callback=lambda n, top, bottom: [search.replace(top[0][2], positions=77)])
    assert len(log.rows) == 60 and log.best[3] == 77 and {o for _, o, _, _ in log.rows} == {"random", "changed", "proposed"}
    assert [r[0] for r in log.rows] == list(range(1, 61)) and log.frame(spark).where("s_lookbacks LIKE '%,%'").count() == 60
    assert len(search.run(lambda batch: [1.0] * len(batch), 60, 7, done=lambda g: len(g.rows) >= 14).rows) == 14


def test_grids_and_validation(spark):
    assert sweep.runs(spark).count() == 27 and sweep.tactical(spark).distinct().count() == 252
    assert sweep.presets(spark, sweep.HYPOTHESES).where("name = 'h1_top5'").first().max_pct == 0.30
    assert sweep.validated({"sizing": "raw"})["max_positions"] == 15
    for bad in ({"colour": 1}, {"min_pct": 0.5, "max_pct": 0.2}, {"leverage": 0}):
        with pytest.raises(ValueError):
            sweep.validated(bad)


def test_option_record(spark):
    o = spark.range(1).select(functions.option_record("put", F.lit(100.0), F.lit(0.3), 0.05).alias("o")).first().o
    assert o.strike == 95.0 and 2 < o.premium < 6 and o.breakeven == pytest.approx(100 + o.premium, abs=0.02) and -0.5 < o.delta < 0
    got = spark.range(1).select(functions.affordable(F.lit(5), F.lit(2.0), F.lit(650.0)).alias("a"), functions.affordable(F.lit(5), F.lit(2.0), F.lit(10.0)).alias("b")).first()
    assert (got.a, got.b) == (3, 0)
    assert [r[0] for r in spark.sql("SELECT explode(array(1.0D, double('nan'), double('inf'), NULL)) x").select(functions.finite_or_zero(F.col("x"))).collect()] == [1, 0, 0, 0]


def test_readers(spark, tmp_path):
    nav = {"meta": {}, "data": [{"date": "31-12-2020", "nav": "12.5"}, {"date": "01-01-2021", "nav": "0"}, {"date": "02-01-2021", "nav": "x"}]}
    (tmp_path / "n.json").write_text(json.dumps(nav))
    assert [(r.date.isoformat(), r.nav) for r in readers.nav_json(spark, str(tmp_path / "n.json")).collect()] == [("2020-12-31", 12.5)]
    landed = spark.createDataFrame([("s", 1), ("s", 2), ("n", 1)], "scheme string, date int")
    assert sorted(map(tuple, readers.new_navs(landed, landed.where("scheme = 's' AND date = 1")).collect())) == [("n", 1), ("s", 2)]
    (tmp_path / "research_log_x.jsonl").write_text('{"iter": 1, "score": 2.5}\nnot json\n{"iter": 2, "score": 3.5}\n')
    log = readers.experiment_log(spark, f"{tmp_path}/*.jsonl", "iter long, score double").collect()
    assert sorted((r.iter, r.tag) for r in log if r.iter is not None) == [(1, "research_log_x"), (2, "research_log_x")] and len(log) == 2
    (tmp_path / "p.csv").write_text(" Month , Close \n Jan-20 ,\"1,234.5\"\n")
    r = readers.padded_csv(spark, str(tmp_path / "p.csv")).select(readers.month_of(F.col("Month")).alias("m"), readers.number(F.col("Close")).alias("c")).first()
    assert (r.m.isoformat(), r.c) == ("2020-01-01", 1234.5)
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>early</i>\n\n2\n00:01:05,000 --> 00:01:06,000\n<b>one</b>\n\n3\n00:01:07,000 --> 00:01:08,000\none\n\n4\n00:01:09,000 --> 00:01:10,000\ntwo\n")
    assert readers.subtitles(spark, str(tmp_path / "s.srt"), 60).first().text == "one two"
    a = spark.range(3).select(F.lit("x").alias("ticker"), F.col("id").alias("date"), F.lit(1.0).alias("close"))
    b = spark.range(5).select(F.lit("x").alias("ticker"), F.col("id").alias("date"), F.lit(2.0).alias("close")).unionByName(a.withColumn("ticker", F.lit("y")))
    got = readers.preferred([a, b], 4)
    assert {(r.ticker, r.close) for r in got.collect()} == {("x", 2.0)} and got.count() == 5
    (tmp_path / "c.json").write_text('{"crash": {"mild": {"p": 0.5}}, "rows": [1, 2]}')
    assert readers.settings(spark, str(tmp_path / "c.json"), "crash struct<mild: struct<p: double>>").select("crash.mild.p").first()[0] == 0.5
    bars = spark.createDataFrame([("s", "2020-01-02", 1.0, 1), ("s", "2020-01-01", 2.0, 0), ("s", "2020-01-02", 1.0, 2)], "symbol string, trade_date string, close double, page int")
    assert [(r.trade_date, r.page) for r in readers.deduplicated_bars(bars).collect()] == [("2020-01-01", 0), ("2020-01-02", 1)]
    names = spark.createDataFrame([(1, "Gold Fund", "2020-01-01", 5.0), (1, "Gold Fund", "2020-02-01", 6.0), (2, "Other", "2020-01-01", 7.0)], "code int, name string, date string, nav double")
    assert [(r.code, r.nav) for r in readers.latest_nav(names, "GOLD").collect()] == [(1, 6.0)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 0.25)], "a string, b string, c double")
    sinks.parquet(frame, str(tmp_path / "p"), ["a"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.append_json(frame, str(tmp_path / "j"))
    sinks.append_json(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    sinks.matrix_csv(frame, "a", "b", "c", str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["a", "x", "y"]
    assert sinks.markdown(frame.limit(1)).split("\n")[0] == "| a | b | c   |"
    sinks.report(frame, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["rows"][0]["a"] == "a"
    made = []
    for _ in range(2):
        got = sinks.fresh(spark, str(tmp_path / "f"), lambda: made.append(1) or frame, "2024-01-01")
        assert got.count() == 3
    assert len(made) == 1 and sinks.fresh(spark, str(tmp_path / "f"), lambda: made.append(1) or frame, "2024-01-02").count() == 3 and len(made) == 2

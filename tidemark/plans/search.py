"""Grids, presets and the search loop, and what is read from their logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import search, sweep
from tidemark.plans.registry import query, r6, sql6, universe
from tidemark.plans.reports import RESULTS, results
from tidemark.plans.scoring import ASKED, scores_at


@query("!SELECT 'runs' AS grid, CAST(27 AS BIGINT) AS n UNION ALL SELECT 'tactical', 252 UNION ALL SELECT 'presets', 15 UNION ALL SELECT 'hypotheses', 16")
def sweep_presets(spark, sf_dir):
    """The sizes of the literal grids."""
    grids = {"runs": sweep.runs(spark), "tactical": sweep.tactical(spark), "presets": sweep.presets(spark, sweep.PRESETS), "hypotheses": sweep.presets(spark, sweep.HYPOTHESES)}
    out = None
    for name, frame in grids.items():  # four fixed grids
        row = frame.agg(F.lit(name).alias("grid"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("@" + ASKED + ", w AS (SELECT ticker, arg_max(close, t) / arg_min(close, t) - 1 AS gain FROM panel WHERE t >= (SELECT max(t) - 252 FROM panel) GROUP BY ticker), win AS (SELECT ticker FROM w ORDER BY round(gain, 8) DESC, ticker LIMIT 5), r AS (SELECT rt, ticker, row_number() OVER (PARTITION BY rt ORDER BY score DESC, ticker) AS rank FROM f WHERE rt >= (SELECT max(t) - 252 FROM panel)) SELECT r.ticker, count(*) AS n, min(rank) AS best_rank, round(avg(rank), 6) AS mean_rank, round(avg(CASE WHEN rank <= 15 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM r JOIN win ON win.ticker = r.ticker GROUP BY r.ticker")
def sim_win_anatomy(spark, sf_dir):
    """Where the last year's five best tickers stood at each rebalance of that year."""
    market = universe(spark, sf_dir)
    last = market.agg((F.max("t") - 252).alias("from"))
    year = market.join(F.broadcast(last), F.col("t") >= F.col("from"))  # one row
    gains = year.groupBy("ticker").agg(F.round(F.max_by("close", "t") / F.min_by("close", "t") - 1, 8).alias("gain"))
    winners = gains.orderBy(F.desc("gain"), "ticker").limit(5).select("ticker")
    ranked = scores_at(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("rt").orderBy(F.desc("score"), "ticker"))).join(F.broadcast(last), F.col("rt") >= F.col("from"))
    rows = ranked.join(winners, "ticker", "left_semi")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"), r6(F.avg("rank")).alias("mean_rank"), r6(F.avg((F.col("rank") <= 15).cast("double"))).alias("hit_rate"))


@query("@c AS (SELECT floor(max(t) * 0.67) AS cut, max(t) AS last FROM panel) SELECT 'train' AS half, count(DISTINCT t) AS days, CAST(min(t) AS BIGINT) AS first, CAST(max(t) AS BIGINT) AS last FROM panel, c WHERE t <= cut UNION ALL SELECT 'test', count(DISTINCT t), CAST(min(t) AS BIGINT), CAST(max(t) AS BIGINT) FROM panel, c WHERE t > cut - 252")
def sim_train_test(spark, sf_dir):
    """Two thirds to train on, the rest with a year before it to test on."""
    train, test = search.halves(universe(spark, sf_dir))
    summed = lambda frame, name: frame.agg(F.lit(name).alias("half"), F.count_distinct("t").alias("days"), F.min("t").cast("long").alias("first"), F.max("t").cast("long").alias("last"))
    return summed(train, "train").unionByName(summed(test, "test"))


@query("@c AS (SELECT unnest(range(1, (SELECT max(t) FROM panel) - 1008 + 2, 126)) AS s), b AS (SELECT ticker, s, arg_min(close, t) AS f, arg_max(close, t) AS l FROM c JOIN panel ON t >= s AND t < s + 1008 GROUP BY 1, 2), g AS (SELECT ticker, s, pow(l / f, 0.25) - 1 AS cagr FROM b), m AS (SELECT s, avg(cagr) AS bench FROM g GROUP BY s) SELECT g.ticker, CAST(g.s AS BIGINT) AS start, round(cagr, 6) AS cagr, CASE WHEN bench >= 0.10 THEN 'bull' WHEN bench <= 0 THEN 'bear' ELSE 'flat' END AS regime FROM g JOIN m ON m.s = g.s")
def sim_window_regimes(spark, sf_dir):
    """Four-year windows of every ticker, each named by the mean growth of all of them."""
    rows = universe(spark, sf_dir).select("ticker", "t", "close")
    last = rows.agg(F.max("t").alias("m"))
    starts = last.where("m >= 1008").select(F.explode(F.sequence(F.lit(1), F.col("m") - 1007, F.lit(126))).alias("start"))
    spans = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / 1008), F.floor((F.col("start") + 1007) / 1008))))
    inside = rows.withColumn("block", F.floor(F.col("t") / 1008)).join(spans, "block").where("t >= start AND t < start + 1008")
    g = inside.groupBy("ticker", "start").agg((F.pow(F.max_by("close", "t") / F.min_by("close", "t"), F.lit(0.25)) - 1).alias("cagr"))
    bench = F.avg("cagr").over(Window.partitionBy("start"))
    return g.select("ticker", F.col("start").cast("long").alias("start"), r6("cagr"), F.when(bench >= 0.10, "bull").when(bench <= 0, "bear").otherwise("flat").alias("regime"))


@query(RESULTS + " SELECT config_id, abs(calmar) >= 8 AND n <= 20 AND annualised >= 0.30 AND config_id % 60 >= 30 AS reached, round((total * 0.5 + annualised + 2 * max_dd + win_rate) / 5 * 100 + annualised * 50 + sortino * 2, 5) AS score FROM x")
def sweep_targets(spark, sf_dir):
    """Which results meet the loop's targets, and the score over regimes."""
    c = F.col
    rows = results(spark, sf_dir)
    score = search.cross_regime(c("total") * 0.5, c("annualised"), c("max_dd"), c("win_rate"), c("annualised"), c("sortino"))
    return rows.select("config_id", search.reached(F.abs("calmar"), c("n_folds"), c("annualised"), c("config_id") % 60).alias("reached"), sql6(score, 5).alias("score"))


@query(RESULTS + ", g AS (SELECT config_id, calmar, consistency, lag(calmar) OVER (ORDER BY config_id) AS pc, lag(consistency) OVER (ORDER BY config_id) AS ps FROM x) SELECT config_id, CASE WHEN round(calmar - pc, 8) > 0 AND round(consistency - ps, 8) <= 0.005 THEN 'keep' WHEN round(consistency - ps, 8) < -0.005 AND round(calmar - pc, 8) > -0.1 THEN 'keep' ELSE 'revert' END AS decision FROM g WHERE pc IS NOT NULL")
def sweep_keep_or_revert(spark, sf_dir):
    """Each result against the one before it: the change in return over risk, and in risk."""
    w = Window.orderBy("config_id")  # a row a configuration
    rows = results(spark, sf_dir).select("config_id", sql6(F.col("calmar") - F.lag("calmar").over(w), 8).alias("a"), sql6(F.col("consistency") - F.lag("consistency").over(w), 8).alias("b"))
    return rows.where("a IS NOT NULL").select("config_id", sweep.keep_or_revert(F.col("a"), F.col("b")).alias("decision"))


@query(RESULTS + ", l AS (SELECT config_id AS iter, 'log' || CAST(config_id % 3 AS VARCHAR) AS tag, calmar AS score FROM x) SELECT tag, iter, round(score, 6) AS score FROM l ORDER BY score DESC, tag, iter LIMIT 1")
def sweep_best_record(spark, sf_dir):
    logs = results(spark, sf_dir).select(F.col("config_id").alias("iter"), F.concat(F.lit("log"), (F.col("config_id") % 3).cast("string")).alias("tag"), F.col("calmar").alias("score"))
    return search.best_record(logs).select("tag", "iter", sql6("score"))


@query(None)
def search_loop(spark, sf_dir):
    """Forty candidates in batches of ten, scored by how their positions and lookbacks did in the score panel: the log of the loop."""
    rows = scores_at(spark, sf_dir).select("rt", "ticker", "score", "mom_1m")
    ahead = rows.withColumn("next", F.lead("mom_1m").over(Window.partitionBy("ticker").orderBy("rt")))
    ranked = ahead.where("next IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("rt").orderBy(F.desc("score"), "ticker")))
    # the mean of the k best, for every k at once: a running mean by rank
    by_rank = ranked.groupBy("rank").agg(F.avg("next").alias("next")).orderBy("rank").collect()  # a row a rank, as many as tickers

    def evaluate(batch: list[search.Candidate]) -> list[float]:
        return [sum(r["next"] for r in by_rank[: c.positions]) / max(1, len(by_rank[: c.positions])) - 0.01 * c.stop for c in batch]

    return search.run(evaluate, 40, 10, callback=lambda n, top, bottom: [search.replace(top[0][2], positions=3)]).frame(spark).select("iter", "origin", r6("score"), "s_lookbacks", "s_positions", "s_min_hold", "s_max_hold", "s_states", "s_profile")

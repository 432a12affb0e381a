"""The scenario report, rolling-return tables, risk reports and screens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import momentum as mom
from tidemark.operators import prep, reports, risk, simulation
from tidemark.plans.registry import query, r6, sql6, universe, with_returns
from tidemark.plans.simulations import LIVE, OOS, TRAIN
from tidemark.sources.panel import by_ticker, panel, read

#: A result table made of orders: a configuration a customer, a fold a year.
FOLDS = "!WITH y AS (SELECT o_custkey AS config_id, year(o_orderdate) AS f, round((CAST(floor(sum(o_totalprice)) AS BIGINT) % 650000) / 1000000.0 - 0.25, 4) AS r FROM orders GROUP BY 1, 2)"
RESULTS = FOLDS + ", lv AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY config_id ORDER BY f) AS level FROM y), dp AS (SELECT *, exp(level - greatest(max(level) OVER (PARTITION BY config_id ORDER BY f), 0)) - 1 AS depth FROM lv), z AS (SELECT config_id, list(r ORDER BY f) AS folds, sum(ln(1 + r)) AS growth, count(*) AS n, min(depth) AS max_dd, sqrt(avg(least(r, 0) * least(r, 0))) AS down, stddev_pop(r) AS consistency, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(r) AS worst FROM dp GROUP BY 1), x AS (SELECT *, round(exp(growth) - 1, 8) AS total, round(exp(growth / n) - 1, 8) AS annualised, round(coalesce((exp(growth / n) - 1) / nullif(down, 0), 0), 8) AS sortino, round(coalesce((exp(growth / n) - 1) / nullif(abs(max_dd), 0), 0), 8) AS calmar, config_id % 5 AS p1, config_id % 7 AS p2 FROM z)"


def fold_table(spark, sf_dir) -> DataFrame:
    """(config_id, fold, ret)."""
    whole = F.floor(F.sum("o_totalprice")).cast("long")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("config_id"), F.year("o_orderdate").alias("fold")).agg(sql6(whole % 650000 / 1000000.0 - 0.25, 4).alias("ret"))


def results(spark, sf_dir) -> DataFrame:
    rows = reports.from_folds(fold_table(spark, sf_dir))
    return rows.select("*").withColumns({c: sql6(c, 8) for c in ("total", "annualised", "sortino", "calmar")}).withColumn("p1", F.col("config_id") % 5).withColumn("p2", F.col("config_id") % 7)


@query(RESULTS + " SELECT config_id, round(total, 6) AS total FROM x ORDER BY total DESC, config_id LIMIT 10")
def report_top_total(spark, sf_dir):
    return reports.best_first(results(spark, sf_dir), "total").select("config_id", sql6("total"))


@query(RESULTS + ", t AS (SELECT unnest([30, 40, 50, 60, 75]) AS cap) SELECT cap, count(*) AS n, round(max(annualised), 6) AS annualised, arg_max(config_id, (annualised, -config_id)) AS config_id FROM x JOIN t ON abs(max_dd) * 100 <= cap GROUP BY cap")
def report_dd_tiers(spark, sf_dir):
    return reports.tiers(results(spark, sf_dir)).select("cap", "n", sql6("annualised"), "config_id")


@query(RESULTS + " SELECT config_id, round(win_rate, 6) AS win_rate, round(annualised, 6) AS annualised FROM x WHERE win_rate >= 0.90 AND annualised > 0")
def report_never_lose(spark, sf_dir):
    return reports.never_lose(results(spark, sf_dir)).select("config_id", sql6("win_rate"), sql6("annualised"))


@query(RESULTS + " SELECT config_id, worst, round(annualised, 6) AS annualised FROM x WHERE worst > -0.20")
def report_no_blowup(spark, sf_dir):
    return reports.no_blowup(results(spark, sf_dir)).select("config_id", F.array_min("fold_returns").alias("worst"), sql6("annualised"))


@query(RESULTS + " SELECT config_id, round(consistency, 6) AS consistency FROM x WHERE annualised > 0.20 ORDER BY round(consistency, 8), config_id LIMIT 10")
def report_steadiest(spark, sf_dir):
    rows = results(spark, sf_dir).where("annualised > 0.20").withColumn("consistency", sql6("consistency", 8))
    return reports.best_first(rows, "consistency", ascending=True).select("config_id", sql6("consistency"))


@query(RESULTS + ", b AS (SELECT *, CASE WHEN abs(max_dd) * 100 <= 0 THEN NULL WHEN abs(max_dd) * 100 <= 25 THEN 0 WHEN abs(max_dd) * 100 <= 35 THEN 25 WHEN abs(max_dd) * 100 <= 45 THEN 35 WHEN abs(max_dd) * 100 <= 55 THEN 45 WHEN abs(max_dd) * 100 <= 70 THEN 55 ELSE 70 END AS band FROM x) SELECT band, count(*) AS n, round(max(calmar), 6) AS calmar, arg_max(config_id, (calmar, -config_id)) AS config_id FROM b WHERE band IS NOT NULL GROUP BY band")
def report_calmar_bands(spark, sf_dir):
    return reports.bands(results(spark, sf_dir)).select("band", "n", sql6("calmar"), "config_id")


@query(RESULTS + " SELECT config_id, round(max_dd, 6) AS max_dd, round(win_rate, 6) AS win_rate FROM x WHERE abs(max_dd) <= 0.30 AND win_rate >= 0.85")
def report_sleep_well(spark, sf_dir):
    return reports.sleep_well(results(spark, sf_dir)).select("config_id", sql6("max_dd"), sql6("win_rate"))


@query(RESULTS + ", e AS (SELECT y.*, row_number() OVER (PARTITION BY config_id ORDER BY r, f) AS rn, lead(r, 1) OVER w AS a, lead(r, 2) OVER w AS b, lead(r, 3) OVER w AS c FROM y WINDOW w AS (PARTITION BY config_id ORDER BY f)) SELECT e.config_id, r AS worst, round((1 + a) * (1 + coalesce(b, 0)) * (1 + coalesce(c, 0)) - 1, 6) AS next3 FROM e JOIN x ON x.config_id = e.config_id WHERE rn = 1 AND n >= 5 AND a IS NOT NULL")
def report_after_worst(spark, sf_dir):
    return reports.after_worst(results(spark, sf_dir)).select("config_id", "worst", sql6("next3"))


@query(RESULTS + ", s AS (SELECT config_id FROM x WHERE abs(max_dd) <= 0.50 ORDER BY total DESC, config_id LIMIT 5) SELECT config_id, " + ", ".join(f"round(quantile_cont(r, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 75, 90)) + ", min(r) AS low, max(r) AS high FROM y WHERE config_id IN (SELECT config_id FROM s) GROUP BY config_id")
def report_fold_percentiles(spark, sf_dir):
    best = reports.best_first(reports.survivors(results(spark, sf_dir)), "total", 5)
    return reports.fold_percentiles(best).select("config_id", *[sql6(f"p{q}") for q in (10, 25, 50, 75, 90)], "low", "high")


@query(RESULTS + ", f AS (SELECT config_id, f, r < 0 AS neg, row_number() OVER (PARTITION BY config_id ORDER BY f) - row_number() OVER (PARTITION BY config_id, r < 0 ORDER BY f) AS island FROM y), l AS (SELECT config_id, island, count(*) AS len FROM f WHERE neg GROUP BY 1, 2), g AS (SELECT config_id, max(len) AS streak FROM l GROUP BY 1) SELECT x.config_id, coalesce(streak, 0) AS streak FROM x LEFT JOIN g ON g.config_id = x.config_id")
def report_losing_streak(spark, sf_dir):
    return results(spark, sf_dir).select("config_id", reports.losing_streak().cast("long").alias("streak"))


_Q = lambda c: ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in reports.PERCENTILES)
_DIST = " UNION ALL ".join(f"SELECT '{n}' AS metric, {_Q(c)} FROM {{0}}" for n, c in (("annualised", "annualised"), ("depth", "abs(max_dd)"), ("sortino", "sortino"), ("calmar", "calmar")))


@query(RESULTS + " " + _DIST.format("x"))
def report_distribution(spark, sf_dir):
    out = reports.distribution(results(spark, sf_dir))
    return out.select("metric", *[sql6(c) for c in out.columns[1:]])


@query(RESULTS + ", s AS (SELECT * FROM x WHERE abs(max_dd) <= 0.50) " + _DIST.format("s"))
def report_survivor_distribution(spark, sf_dir):
    out = reports.distribution(reports.survivors(results(spark, sf_dir)))
    return out.select("metric", *[sql6(c) for c in out.columns[1:]])


_STORM = f"@l AS (SELECT max(t) - 1 AS last FROM panel), f0 AS (SELECT s AS start, least(s + {OOS}, last) AS stop FROM l, (SELECT unnest(range({TRAIN}, 100000, {OOS})) AS s) WHERE least(s + {OOS}, last) - s >= 21), fo AS (SELECT row_number() OVER (ORDER BY start) AS fold, start, stop FROM (SELECT f.start, f.stop, count(*) AS n FROM f0 f JOIN (SELECT ticker, min(t) AS born FROM panel GROUP BY ticker) b ON born <= f.start GROUP BY 1, 2) WHERE n >= {LIVE}), v AS (SELECT fold, ticker, stddev_pop(coalesce(ret, 0)) * sqrt(252) AS v FROM rets JOIN fo ON t > start + 1 AND t <= stop GROUP BY 1, 2), m AS (SELECT fold, quantile_cont(v, 0.5) AS vol FROM v GROUP BY 1), st AS (SELECT fold, vol, vol >= (SELECT quantile_cont(vol, 0.75) FROM m) AS stormy FROM m)"


@query(_STORM + " SELECT fold, round(vol, 5) AS vol, stormy FROM st")
def report_stormy_folds(spark, sf_dir):
    market = universe(spark, sf_dir)
    return reports.stormy_folds(market, simulation.expanding_folds(market, TRAIN, OOS, LIVE)).select("fold", sql6("vol", 5), "stormy")


@query(_STORM + ", e AS (SELECT ticker AS config_id, fold, arg_max(close, t) / arg_min(close, t) - 1 AS ret FROM panel JOIN fo ON t > start AND t <= stop GROUP BY 1, 2) SELECT config_id, round(avg(ret), 6) AS storm_return, count(*) AS n FROM e JOIN st ON st.fold = e.fold AND stormy GROUP BY 1")
def report_in_storms(spark, sf_dir):
    """Each held ticker's mean return in the stormy folds."""
    market = universe(spark, sf_dir)
    folds = simulation.expanding_folds(market, TRAIN, OOS, LIVE)
    held = market.join(F.broadcast(folds), (F.col("t") > F.col("start")) & (F.col("t") <= F.col("stop")))  # some dozens of folds
    per = held.groupBy(F.col("ticker").alias("config_id"), "fold").agg((F.max_by("close", "t") / F.min_by("close", "t") - 1).alias("ret"))
    return reports.in_storms(per, reports.stormy_folds(market, folds)).select("config_id", sql6("storm_return"), "n")


@query(RESULTS + " SELECT count(*) AS n, round(max(annualised), 6) AS best, round(quantile_cont(annualised, 0.5), 6) AS median, round(min(annualised), 6) AS worst, round(max(max_dd), 6) AS least_depth, round(quantile_cont(max_dd, 0.5), 6) AS median_depth, round(min(max_dd), 6) AS deepest FROM x")
def report_extremes(spark, sf_dir):
    out = reports.extremes(results(spark, sf_dir))
    return out.select("n", *[sql6(c) for c in out.columns[1:]])


_PLACED = RESULTS + ", pl AS (SELECT *, row_number() OVER (ORDER BY annualised DESC, config_id) AS place, count(*) OVER () AS total_rows FROM x), vs AS (SELECT 'p1' AS param, CAST(p1 AS VARCHAR) AS value, place, total_rows FROM pl UNION ALL SELECT 'p2', CAST(p2 AS VARCHAR), place, total_rows FROM pl)"


@query(_PLACED + " SELECT param, value, count(*) AS n FROM vs WHERE place <= 50 GROUP BY 1, 2")
def report_value_frequency(spark, sf_dir):
    return reports.value_frequency(results(spark, sf_dir), ["p1", "p2"])


_QUARTER = ", qf AS (SELECT param, value, CAST(sum(CASE WHEN place <= total_rows // 4 THEN 1 ELSE 0 END) AS BIGINT) AS best, CAST(sum(CASE WHEN place > total_rows - total_rows // 4 THEN 1 ELSE 0 END) AS BIGINT) AS worst FROM vs GROUP BY 1, 2)"


@query(_PLACED + _QUARTER + " SELECT param, value, best, worst FROM qf")
def agg_quartile_frequency(spark, sf_dir):
    return reports.quartile_frequency(results(spark, sf_dir), ["p1", "p2"])


@query(RESULTS + ", g AS (SELECT *, CAST(floor(annualised * 40) AS BIGINT) AS p3 FROM x), pl AS (SELECT *, row_number() OVER (ORDER BY annualised DESC, config_id) AS place, count(*) OVER () AS total_rows FROM g), vs AS (SELECT 'p1' AS param, CAST(p1 AS VARCHAR) AS value, place, total_rows FROM pl UNION ALL SELECT 'p3', CAST(p3 AS VARCHAR), place, total_rows FROM pl)" + _QUARTER + " SELECT param, value FROM qf WHERE worst > 0 AND worst >= 5 * greatest(best, 1)")
def report_dead_values(spark, sf_dir):
    """Parameter values that hardly ever do well; p3 follows the outcome, so some of its values are dead."""
    rows = results(spark, sf_dir).withColumn("p3", F.floor(F.col("annualised") * 40))
    return reports.dead_values(reports.quartile_frequency(rows, ["p1", "p3"]))


@query(RESULTS + " SELECT config_id, 'top' AS side, round(total, 6) AS total FROM (SELECT * FROM x ORDER BY total DESC, config_id LIMIT 5) UNION ALL SELECT config_id, 'bottom', round(total, 6) FROM (SELECT * FROM x ORDER BY total, config_id LIMIT 5)")
def rank_top_bottom(spark, sf_dir):
    """Both ends of a log."""
    rows = results(spark, sf_dir)
    return reports.best_first(rows, "total", 5).select("config_id", F.lit("top").alias("side"), sql6("total")).unionByName(reports.best_first(rows, "total", 5, ascending=True).select("config_id", F.lit("bottom").alias("side"), sql6("total")))


@query(RESULTS + ", v AS (SELECT p1 AS strategy, config_id, max_dd, row_number() OVER (PARTITION BY p1 ORDER BY round(max_dd, 8) DESC, config_id) AS rn, calmar FROM x) SELECT strategy, config_id, round(calmar, 6) AS calmar FROM v WHERE rn = 1")
def rank_best_variant(spark, sf_dir):
    """Of each strategy the variant of least depth."""
    w = Window.partitionBy("p1").orderBy(sql6("max_dd", 8).desc(), "config_id")
    return results(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("p1").alias("strategy"), "config_id", sql6("calmar"))


# --- risk reports -----------------------------------------------------------------------------------------------------
_MONTHS = "+mo AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) AS close FROM panel GROUP BY 1, 2), mr AS (SELECT ticker, period, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY period) - 1 AS r FROM mo)"


@query(_MONTHS + ", s AS (SELECT ticker, count(r) AS n, arg_max(close, period) / arg_min(close, period) AS growth, stddev_samp(r) * sqrt(12) AS risk, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(12) AS down FROM mr GROUP BY ticker), d AS (SELECT ticker, min(close / m - 1) AS max_dd FROM (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY period) AS m FROM mo) GROUP BY ticker) SELECT s.ticker, round(pow(growth, 12.0 / n) - 1, 6) AS cagr, round(risk, 6) AS risk, round((pow(growth, 12.0 / n) - 1 - 0.07) / risk, 6) AS sharpe, round((pow(growth, 12.0 / n) - 1 - 0.07) / down, 6) AS sortino, round(max_dd, 6) AS max_dd, round((pow(growth, 12.0 / n) - 1) / -max_dd, 6) AS calmar FROM s JOIN d ON d.ticker = s.ticker")
def risk_strategy_stats(spark, sf_dir):
    """Monthly statistics over a 7 % risk-free rate."""
    out = risk.strategy_stats(prep.resample(panel(spark, sf_dir)), ["ticker"], "close", "period", 12, 0.07)
    return out.select("ticker", *[r6(c) for c in ("cagr", "risk", "sharpe", "sortino", "max_dd", "calmar")])


@query("+dd AS (SELECT ticker, t, close / max(close) OVER (PARTITION BY ticker ORDER BY t) - 1 AS dd FROM panel), mo AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(close, date) / arg_min(close, date) - 1 AS r FROM panel GROUP BY 1, 2), p AS (SELECT ticker, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95, avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END) AS losing FROM mo GROUP BY 1), a AS (SELECT ticker, pow(arg_max(close, t) / arg_min(close, t), 252.0 / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS vol FROM rets GROUP BY 1) SELECT d.ticker, round(min(dd), 6) AS max_dd, round(arg_max(dd, t), 6) AS current_dd, round(max(p5), 6) AS p5, round(max(p50), 6) AS p50, round(max(p95), 6) AS p95, round(max(losing), 6) AS losing, round(max(cagr), 6) AS cagr, round(max(vol), 6) AS vol FROM dd d JOIN p ON p.ticker = d.ticker JOIN a ON a.ticker = d.ticker GROUP BY d.ticker")
def risk_pain_report(spark, sf_dir):
    """Depth now and at worst, the spread of months, and yearly figures."""
    out = risk.pain_report(with_returns(spark, sf_dir))
    return out.select("ticker", *[r6(c) for c in ("max_dd", "current_dd", "p5", "p50", "p95", "losing", "cagr", "vol")])


_RANKED = [("cagr", "DESC"), ("max_dd", "DESC"), ("vol", "ASC")]


@query("+s AS (SELECT ticker, round(pow(arg_max(close, t) / arg_min(close, t), 252.0 / count(*)) - 1, 8) AS cagr, round(stddev_samp(ret), 8) AS vol FROM rets GROUP BY 1), d AS (SELECT ticker, round(min(close / m - 1), 8) AS max_dd FROM (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY t) AS m FROM panel) GROUP BY 1), j AS (SELECT s.ticker, cagr, CASE WHEN s.ticker = 'SMALL' THEN NULL ELSE vol END AS vol, max_dd FROM s JOIN d ON d.ticker = s.ticker) SELECT ticker, CAST(row_number() OVER (ORDER BY coalesce(cagr, -999) DESC, ticker) + row_number() OVER (ORDER BY coalesce(max_dd, -999) DESC, ticker) + row_number() OVER (ORDER BY coalesce(vol, 999), ticker) AS BIGINT) AS rank_sum FROM j")
def risk_fund_rank(spark, sf_dir):
    """The sum of ranks by three measures, a missing one ranked last."""
    rows = with_returns(spark, sf_dir).withColumn("dd", risk.drawdown())
    s = rows.groupBy("ticker").agg(F.round(F.pow(F.max_by("close", "t") / F.min_by("close", "t"), 252.0 / F.count("*")) - 1, 8).alias("cagr"), F.round(F.stddev_samp("ret"), 8).alias("vol"), F.round(F.min("dd"), 8).alias("max_dd"))
    s = s.withColumn("vol", F.when(F.col("ticker") != "SMALL", F.col("vol")))
    return risk.rank_sum(s, "ticker", {"cagr": True, "max_dd": True, "vol": False})


@query("+mr AS (SELECT ticker, t, close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY t) - 1 AS r FROM panel) SELECT ticker, " + ", ".join(f"round(quantile_cont(r, {q / 100}), 6) AS p{q}" for q in (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)) + ", round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS gain FROM mr WHERE r IS NOT NULL GROUP BY ticker")
def risk_distribution(spark, sf_dir):
    """Value at risk and the whole percentile table of 21-day returns."""
    rows = panel(spark, sf_dir).withColumn("r", mom.no_skip(21)).where("r IS NOT NULL")
    qs = (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)
    g = rows.groupBy("ticker").agg(F.expr(f"percentile(r, array({', '.join(str(q / 100) for q in qs)}))").alias("p"), F.avg((F.col("r") < 0).cast("double")).alias("loss"), F.avg((F.col("r") > 0).cast("double")).alias("gain"))
    return g.select("ticker", *[r6(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate(qs)], r6("loss"), r6("gain"))


@query("+q AS (SELECT ticker, t, close / max(close) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) - 1 AS d, max(t) OVER (PARTITION BY ticker) AS last FROM panel) SELECT ticker, round(min(d), 6) AS worst FROM q WHERE t < last GROUP BY ticker")
def risk_worst_quarter(spark, sf_dir):
    """The worst drawdown inside any 63 days that end before the last one: every window counts."""
    rows = panel(spark, sf_dir).withColumn("d", risk.depth_in(63)).withColumn("last", F.max("t").over(Window.partitionBy("ticker")))
    return rows.where("t < last").groupBy("ticker").agg(r6(F.min("d")).alias("worst"))


@query("@b AS (SELECT ticker, (t - 1) // 252 AS y, arg_max(close, t) / arg_min(close, t) - 1 AS r FROM panel GROUP BY 1, 2), m AS (SELECT y, avg(r) AS m FROM b GROUP BY y) SELECT ticker, round(avg(CASE WHEN r > m THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM b JOIN m ON b.y = m.y GROUP BY ticker")
def risk_yearly_win_rate(spark, sf_dir):
    """Against the mean of all tickers, in years of 252 days of one calendar."""
    b = universe(spark, sf_dir).groupBy("ticker", F.floor((F.col("t") - 1) / 252).alias("y")).agg((F.max_by("close", "t") / F.min_by("close", "t") - 1).alias("r"))
    m = b.groupBy("y").agg(F.avg("r").alias("m"))
    return b.join(m, "y").groupBy("ticker").agg(r6(F.avg((F.col("r") > F.col("m")).cast("double"))).alias("win_rate"))


@query("@x AS (SELECT a.ticker AS a, b.ticker AS b, a.t, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.t = b.t AND a.ticker < b.ticker AND a.ticker LIKE 'Brand#1%' AND b.ticker LIKE 'Brand#1%' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL), c AS (SELECT a, b, t, count(*) OVER w AS n, covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) AS c FROM x WINDOW w AS (PARTITION BY a, b ORDER BY t ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) SELECT a, b, t, round(c, 6) AS c FROM c WHERE n = 90")
def risk_rolling_correlation(spark, sf_dir):
    """Over 90 common days, of every pair of one family of tickers."""
    rows = universe(spark, sf_dir).where(F.col("ticker").startswith("Brand#1") & F.col("ret").isNotNull())
    out = risk.rolling_correlations(rows, 90)
    return out.select("a", "b", "t", r6("c"))


@query("@wt AS (SELECT ticker, row_number() OVER (ORDER BY ticker) * 1.0 AS w FROM (SELECT DISTINCT ticker FROM panel)), d AS (SELECT r.t, sum(wt.w * r.ret) / sum(wt.w) AS r FROM rets r JOIN wt ON r.ticker = wt.ticker WHERE r.ret IS NOT NULL GROUP BY r.t), l AS (SELECT t, r, sum(ln(greatest(1 + r, 1e-12))) OVER (ORDER BY t) AS level FROM d), e AS (SELECT *, exp(level - greatest(max(level) OVER (ORDER BY t), 0)) - 1 AS dd FROM l) SELECT count(*) AS n, round(avg(r) * 252, 6) AS mean, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 6) AS sharpe, round(avg(r) * 252 / (stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252)), 6) AS sortino, round(min(dd), 6) AS max_dd FROM e")
def risk_weighted_portfolio(spark, sf_dir):
    """Weights brought to a sum of one over the tickers that have a return that day."""
    rows = universe(spark, sf_dir).where("ret IS NOT NULL")
    # one row a ticker before the ordered window
    weights = rows.select("ticker").distinct().withColumn("w", F.row_number().over(Window.orderBy("ticker")) * 1.0)
    out = risk.weighted_portfolio(rows, weights)
    return out.select("n", *[r6(c) for c in ("mean", "vol", "sharpe", "sortino", "max_dd")])


# --- screens and league tables ----------------------------------------------------------------------------------------
@query("@y AS (SELECT ticker, t, " + ", ".join(f"pow(close / lag(close, {252 * k}) OVER w, 1.0 / {k}) - 1 AS y{k}" for k in (1, 3, 5)) + " FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t)), s AS (SELECT ticker, " + ", ".join(f"round(avg(y{k}), 6) AS mean_{k}, round(min(y{k}), 6) AS worst_{k}, round(quantile_cont(y{k}, 0.5), 6) AS median_{k}, round(arg_max(y{k}, t), 6) AS latest_{k}" for k in (1, 3, 5)) + " FROM y GROUP BY ticker) SELECT *, row_number() OVER (ORDER BY mean_3 DESC NULLS LAST, ticker) AS place FROM s")
def report_league_table(spark, sf_dir):
    """Rolling returns over one, three and five years, placed by the mean of three."""
    rows = universe(spark, sf_dir).select("ticker", "t", *[mom.rolling_cagr(k).alias(f"y{k}") for k in (1, 3, 5)])
    s = rows.groupBy("ticker").agg(*[x for k in (1, 3, 5) for x in (r6(F.avg(f"y{k}")).alias(f"mean_{k}"), r6(F.min(f"y{k}")).alias(f"worst_{k}"), r6(F.expr(f"percentile(y{k}, 0.5)")).alias(f"median_{k}"), r6(F.max_by(f"y{k}", F.when(F.col(f"y{k}").isNotNull(), F.col("t")))).alias(f"latest_{k}"))])
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_3").desc_nulls_last(), "ticker")))  # a row a ticker


_SCREEN = "@sx AS (SELECT ticker, substr(ticker, 1, 7) AS segment, sum(dividend) / sum(CASE WHEN traded THEN 1 ELSE 0 END) AS yield, arg_max(close, t) / arg_min(close, t) - 1 AS gain, avg(dvol) AS adv, stddev_samp(ret) * sqrt(252) AS vol FROM rets GROUP BY 1, 2), sc AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(yield, 8) DESC, ticker) AS own FROM sx WHERE yield >= 0.04)"


@query(_SCREEN + " SELECT ticker, segment, round(yield, 6) AS yield, round(vol, 6) AS vol, own FROM sc")
def report_screen(spark, sf_dir):
    """Tickers that yield at least 4 %, placed within their segment."""
    return screen(spark, sf_dir).select("ticker", "segment", r6("yield"), r6("vol"), "own")


def screen(spark, sf_dir) -> DataFrame:
    rows = universe(spark, sf_dir)
    s = rows.groupBy("ticker", F.substring("ticker", 1, 7).alias("segment")).agg((F.sum("dividend") / F.sum(F.col("traded").cast("int"))).alias("yield"), (F.max_by("close", "t") / F.min_by("close", "t") - 1).alias("gain"), F.avg("dvol").alias("adv"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"))
    return s.where("yield >= 0.04").withColumn("own", F.row_number().over(Window.partitionBy("segment").orderBy(F.round("yield", 8).desc(), "ticker")))


@query(_SCREEN + " SELECT scenario, ticker, round(w / sum(w) OVER (PARTITION BY scenario), 6) AS w FROM (SELECT 'equal' AS scenario, ticker, 1.0 AS w FROM sc WHERE own <= 2 UNION ALL SELECT 'yield', ticker, yield FROM sc WHERE own <= 2 UNION ALL SELECT 'steady', ticker, 1 / vol FROM sc WHERE own <= 2)")
def report_screen_scenarios(spark, sf_dir):
    """Three allocations of the two best of each segment: equal, by yield, by the inverse of volatility."""
    best = screen(spark, sf_dir).where("own <= 2")
    options = F.array(F.struct(F.lit("equal").alias("scenario"), F.lit(1.0).alias("w")), F.struct(F.lit("yield").alias("scenario"), F.col("yield").alias("w")), F.struct(F.lit("steady").alias("scenario"), (1 / F.col("vol")).alias("w")))
    rows = best.select("ticker", F.explode(options).alias("x")).select("x.scenario", "ticker", "x.w")
    return rows.select("scenario", "ticker", r6(F.col("w") / F.sum("w").over(Window.partitionBy("scenario"))).alias("w"))


@query(_SCREEN.replace("WHERE yield >= 0.04", "") + " SELECT segment, count(*) AS n, round(avg(yield), 6) AS mean_yield, round(min(vol), 6) AS low, round(max(vol), 6) AS high, arg_max(ticker, (round(yield, 8), ticker)) AS best, row_number() OVER (ORDER BY round(avg(yield), 8) DESC, segment) AS place FROM sc GROUP BY segment")
def agg_segments(spark, sf_dir):
    rows = universe(spark, sf_dir)
    s = rows.groupBy("ticker", F.substring("ticker", 1, 7).alias("segment")).agg((F.sum("dividend") / F.sum(F.col("traded").cast("int"))).alias("yield"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"))
    g = s.groupBy("segment").agg(F.count("*").alias("n"), F.avg("yield").alias("y"), r6(F.min("vol")).alias("low"), r6(F.max("vol")).alias("high"), F.max(F.struct(F.round("yield", 8).alias("y"), "ticker")).alias("b"))
    return g.select("segment", "n", r6("y").alias("mean_yield"), "low", "high", F.col("b.ticker").alias("best"), F.row_number().over(Window.orderBy(F.round("y", 8).desc(), "segment")).alias("place"))  # a row a segment


@query("!WITH c AS (SELECT s_nationkey AS fund, s_suppkey, s_acctbal AS x, 1.0 + s_suppkey % 7 AS w FROM supplier), p AS (SELECT n_nationkey AS fund, n_nationkey * 100.0 AS parent FROM nation) SELECT c.fund, round(sum(w * x) / sum(w), 6) AS mean, round(sum(w * x) / sum(w) - max(parent), 6) AS gap FROM c JOIN p ON p.fund = c.fund GROUP BY c.fund")
def agg_weighted_constituents(spark, sf_dir):
    """Constituents' weighted mean against the parent's own value."""
    c = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("fund"), F.col("s_acctbal").alias("x"), (1.0 + F.col("s_suppkey") % 7).alias("w"))
    p = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fund"), (F.col("n_nationkey") * 100.0).alias("parent"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    return c.groupBy("fund").agg(mean.alias("m")).join(p, "fund").select("fund", r6("m").alias("mean"), r6(F.col("m") - F.col("parent")).alias("gap"))

"""Walk-forward periods, engines, forward windows and Monte-Carlo paths, with their SQL where nothing depends on its own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import allocation, engines, hmm, montecarlo, prep, risk, scoring, signals, simulation, sweep, walkforward
from tidemark.operators import momentum as mom
from tidemark.plans.registry import NEG, ROOT, fr, kept, query, r6, universe, with_returns
from tidemark.plans.scoring import ASKED, CACHE, MIX, STEP, WARM, rebalances, scores_at
from tidemark.sources.panel import aligned, panel, read

TRAIN, OOS, LIVE = 504, 252, 15


@query(f"@l AS (SELECT max(t) - 1 AS last FROM panel), s AS (SELECT s AS start, least(s + {OOS}, last) AS stop FROM l, (SELECT unnest(range({TRAIN}, 100000, {OOS})) AS s) WHERE least(s + {OOS}, last) - s >= 21), b AS (SELECT ticker, min(t) AS born FROM panel GROUP BY ticker) SELECT row_number() OVER (ORDER BY start) AS fold, start, stop, live FROM (SELECT start, stop, count(*) AS live FROM s JOIN b ON born <= start GROUP BY 1, 2) WHERE live >= {LIVE}")
def sim_folds(spark, sf_dir):
    return simulation.expanding_folds(universe(spark, sf_dir), TRAIN, OOS, LIVE).select("fold", F.col("start").cast("long"), F.col("stop").cast("long"), "live")


TOP3 = "@" + ASKED + f", p3 AS (SELECT rt, rt + {STEP} AS until, ticker, 1.0 / 3 AS w FROM (SELECT rt, ticker, row_number() OVER (PARTITION BY rt ORDER BY score DESC, ticker) AS rank FROM f WHERE score > 0) WHERE rank <= 3)"


def top3(spark, sf_dir) -> DataFrame:
    rows = scoring.top(scores_at(spark, sf_dir).where("score > 0"), ["rt"], 3)
    return rows.select(F.lit(1).alias("config_id"), "rt", (F.col("rt") + STEP).alias("until"), "ticker", F.lit(1.0 / 3).alias("w"))


@query(TOP3 + ", d AS (SELECT rt, r.t, sum(w * coalesce(ret, 0)) AS r FROM p3 JOIN rets r ON r.ticker = p3.ticker AND r.t > rt AND r.t <= until GROUP BY 1, 2) SELECT rt, round(sum(ln(greatest(1 + r, 1e-12))), 6) AS log_growth, count(*) AS days FROM d GROUP BY rt")
def sim_periods_daily(spark, sf_dir):
    return simulation.period_returns(universe(spark, sf_dir), top3(spark, sf_dir), ["config_id"]).select("rt", r6("log_growth"), "days")


@query(TOP3 + ", e AS (SELECT rt, r.ticker, max(w) AS w, arg_max(r.close, r.t) AS x, count(*) AS n FROM p3 JOIN rets r ON r.ticker = p3.ticker AND r.t > rt AND r.t <= until GROUP BY 1, 2) SELECT rt, round(ln(1 + sum(e.w * (x / b.close - 1))), 6) AS log_growth, max(e.n) AS days FROM e JOIN panel b ON b.ticker = e.ticker AND b.t = rt GROUP BY rt")
def sim_periods_shares(spark, sf_dir):
    return simulation.period_returns(universe(spark, sf_dir), top3(spark, sf_dir), ["config_id"], "shares").select("rt", r6("log_growth"), "days")


@query(TOP3 + f", h AS (SELECT ticker, (rt - {WARM}) // {STEP} AS k FROM p3), g AS (SELECT ticker, k - row_number() OVER (PARTITION BY ticker ORDER BY k) AS island FROM h), l AS (SELECT ticker, island, count(*) AS len FROM g GROUP BY 1, 2) SELECT ticker, count(*) AS spells, max(len) AS longest, round(avg(len), 6) AS mean_len FROM l GROUP BY ticker")
def report_holding_spells(spark, sf_dir):
    h = top3(spark, sf_dir).select("ticker", F.floor((F.col("rt") - WARM) / STEP).alias("k"))
    g = h.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("ticker").orderBy("k"))).groupBy("ticker", "island").agg(F.count("*").alias("len"))
    return g.groupBy("ticker").agg(F.count("*").alias("spells"), F.max("len").alias("longest"), r6(F.avg("len")).alias("mean_len"))


# --- out-of-sample batches --------------------------------------------------------------------------------------------
#: Two signatures, two sizes, two frequencies; tickers 'Brand#2%' are the havens of dual momentum.
SIGNATURES = ["sortino", "dual+volscale"]
SIZES, FREQUENCIES = [3, 8], [21, 63]


def oos_grid(spark: SparkSession) -> DataFrame:
    """config_id, signature, positions, frequency, dual, volscale: sizes and frequencies share a signature's scores."""
    grid = sweep.profiles(spark, SIGNATURES).withColumn("positions", F.explode(F.lit(SIZES))).withColumn("frequency", F.explode(F.lit(FREQUENCIES)))
    grid = grid.select(F.col("profile").alias("signature"), "positions", "frequency", F.col("flags")["dual"].alias("dual"), F.col("flags")["volscale"].alias("volscale"))
    number = F.when(F.col("signature") == SIGNATURES[0], 0).otherwise(4) + F.when(F.col("positions") == SIZES[0], 0).otherwise(2) + F.when(F.col("frequency") == FREQUENCIES[0], 0).otherwise(1)
    return grid.withColumn("config_id", number.cast("long"))


def oos_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(market, folds, weights) of the batch: each signature is scored once, at the rebalance days only."""
    market = kept(universe(spark, sf_dir))
    folds = kept(simulation.expanding_folds(market, TRAIN, OOS, LIVE))
    grid = oos_grid(spark)
    days = kept(walkforward.rebalance_days(folds, grid))
    cache = scoring.signal_cache(market, [(63, 21), (126, 21), (252, 21)], ["none"])
    now = cache.join(days.select(F.col("rt").alias("t")).distinct(), "t", "left_semi")
    blend = 0.2 * F.col("m_none_63_21") + 0.4 * F.col("m_none_126_21") + 0.4 * F.col("m_none_252_21")
    rows = now.crossJoin(F.broadcast(sweep.profiles(spark, SIGNATURES)))  # two signatures
    scores = rows.select(F.col("profile").alias("signature"), "t", "ticker", F.round(scoring.switched(rows, blend, F.col("flags")), 8).alias("score"), F.round("tv", 8).alias("tv"), F.round("abs12", 8).alias("abs12"))
    havens = market.where(F.col("ticker").startswith("Brand#2")).select("ticker").distinct()
    # a row a configuration, rebalance and position: kept, as costs and values read it several times
    return market, folds, kept(walkforward.weights(scores, grid, days, havens))


OOS_SQL = "@" + CACHE.format(momentum=MIX) + f""", l AS (SELECT max(t) - 1 AS last FROM panel),
fold0 AS (SELECT s AS start, least(s + {OOS}, last) AS stop FROM l, (SELECT unnest(range({TRAIN}, 100000, {OOS})) AS s) WHERE least(s + {OOS}, last) - s >= 21),
folds AS (SELECT row_number() OVER (ORDER BY start) AS fold, start, stop FROM (SELECT f.start, f.stop, count(*) AS n FROM fold0 f JOIN (SELECT ticker, min(t) AS born FROM panel GROUP BY ticker) b ON born <= f.start GROUP BY 1, 2) WHERE n >= {LIVE}),
grid AS (SELECT s.sig, p.positions, q.frequency, s.base + p.base + q.base AS config_id, s.base = 4 AS dual FROM (SELECT 'sortino' AS sig, 0 AS base UNION ALL SELECT 'dual+volscale', 4) s, (SELECT {SIZES[0]} AS positions, 0 AS base UNION ALL SELECT {SIZES[1]}, 2) p, (SELECT {FREQUENCIES[0]} AS frequency, 0 AS base UNION ALL SELECT {FREQUENCIES[1]}, 1) q),
reb AS (SELECT config_id, sig, positions, frequency, dual, fold, start, stop, k, start + k * frequency + 1 AS rt, least(start + (k + 1) * frequency, stop) + 1 AS until FROM grid, folds, (SELECT unnest(range(0, 1000)) AS k) WHERE start + k * frequency < stop),
sig AS (SELECT 'sortino' AS sig, ticker, t, round(CASE WHEN blend > 0 THEN blend / dn ELSE -1 END, 8) AS score, round(tv, 8) AS tv, round(abs12, 8) AS abs12 FROM cache UNION ALL SELECT 'dual+volscale', ticker, t, round(CASE WHEN blend > 0 THEN CASE WHEN abs12 > 0 THEN blend ELSE -1 END ELSE -1 END, 8), round(tv, 8), round(abs12, 8) FROM cache),
live AS (SELECT *, row_number() OVER (PARTITION BY sig, t ORDER BY score DESC, ticker) AS rank FROM sig WHERE score > 0 AND ticker NOT LIKE 'Brand#2%'),
haven AS (SELECT sig, t, max_by(ticker, (abs12, ticker)) AS haven FROM sig WHERE ticker LIKE 'Brand#2%' GROUP BY 1, 2),
pick AS (SELECT r.*, v.ticker, v.tv FROM reb r JOIN live v ON v.sig = r.sig AND v.t = r.rt AND v.rank <= r.positions),
cnt AS (SELECT r.*, coalesce(p.n, 0) AS n, p.inv, h.haven FROM reb r LEFT JOIN (SELECT config_id, fold, k, count(*) AS n, sum(1 / tv) AS inv FROM pick GROUP BY 1, 2, 3) p ON p.config_id = r.config_id AND p.fold = r.fold AND p.k = r.k LEFT JOIN haven h ON h.sig = r.sig AND h.t = r.rt),
ws AS (SELECT p.config_id, p.fold, p.k, p.rt, p.until, p.ticker, CASE WHEN c.dual AND c.haven IS NOT NULL AND c.n < c.positions THEN c.n * 1.0 / c.positions ELSE 1 END * CASE WHEN c.dual THEN 1 / p.tv / c.inv ELSE 1.0 / c.n END AS w
  FROM pick p JOIN cnt c ON c.config_id = p.config_id AND c.fold = p.fold AND c.k = p.k
  UNION ALL SELECT config_id, fold, k, rt, until, haven, 1 - n * 1.0 / positions FROM cnt WHERE dual AND haven IS NOT NULL AND n < positions),
held AS (SELECT *, k - row_number() OVER (PARTITION BY config_id, fold, ticker ORDER BY k) AS spell FROM ws),
spells AS (SELECT *, min(rt) OVER (PARTITION BY config_id, fold, ticker, spell) AS since FROM held),
act AS (SELECT DISTINCT config_id, fold, k, rt FROM ws),
both_ AS (SELECT a.config_id, a.fold, a.k, a.rt, x.ticker, coalesce(n.w, 0) AS new, coalesce(o.w, 0) AS old, o.since FROM act a JOIN (SELECT config_id, fold, k, ticker FROM spells UNION SELECT config_id, fold, k + 1, ticker FROM spells) x ON x.config_id = a.config_id AND x.fold = a.fold AND x.k = a.k
  LEFT JOIN spells n ON n.config_id = a.config_id AND n.fold = a.fold AND n.k = a.k AND n.ticker = x.ticker LEFT JOIN spells o ON o.config_id = a.config_id AND o.fold = a.fold AND o.k = a.k - 1 AND o.ticker = x.ticker),
cost AS (SELECT config_id, fold, k, b.rt, CASE WHEN sum(abs(new - old)) < 0.001 THEN 0 ELSE greatest(sum(abs(new - old)) * 50000 / 75.0 * 0.0037, sum(CASE WHEN abs(new - old) > 0.001 THEN 1 ELSE 0 END) * 0.35) / 50000 + sum(abs(new - old)) * 0.0005
  + 0.21 * sum(greatest(old - new, 0) * greatest(coalesce(p.close / e.close - 1, 0), 0)) END AS cost FROM both_ b JOIN panel p ON p.ticker = b.ticker AND p.t = b.rt LEFT JOIN panel e ON e.ticker = b.ticker AND e.t = b.since GROUP BY 1, 2, 3, 4),
day AS (SELECT w.config_id, w.fold, r.t, ln(greatest(1 + sum(w.w * coalesce(r.ret, 0)), 1e-12)) AS g FROM ws w JOIN rets r ON r.ticker = w.ticker AND r.t > w.rt AND r.t <= w.until GROUP BY 1, 2, 3
  UNION ALL SELECT config_id, fold, rt, ln(greatest(1 - cost, 1e-12)) FROM cost),
days_ AS (SELECT d.config_id, d.fold, d.t, sum(CASE WHEN d.t > f.start + 1 THEN g ELSE 0 END) AS g, max(d.t > f.start + 1) AS after FROM day d JOIN folds f ON f.fold = d.fold GROUP BY 1, 2, 3)"""


@query(OOS_SQL + " SELECT config_id, fold, k, ticker, round(sum(w), 6) AS w FROM ws GROUP BY 1, 2, 3, 4")
def sim_oos_weights(spark, sf_dir):
    """Weights of every configuration, fold and rebalance, what is left of the positions in the best haven."""
    return oos_parts(spark, sf_dir)[2].select("config_id", "fold", "k", "ticker", r6("w"))


@query(OOS_SQL + " SELECT config_id, fold, k, round(cost, 8) AS cost FROM cost")
def sim_oos_costs(spark, sf_dir):
    market, _, weights = oos_parts(spark, sf_dir)
    return walkforward.costs(market, weights).select("config_id", "fold", "k", F.round("cost", 8).alias("cost"))


@query(OOS_SQL + " SELECT config_id, fold, round(sum(g), 6) AS log_growth FROM days_ GROUP BY 1, 2")
def sim_oos_folds(spark, sf_dir):
    market, folds, weights = oos_parts(spark, sf_dir)
    per = walkforward.fold_results(walkforward.daily_values(market, weights, folds), folds)
    return per.select("config_id", "fold", r6("growth").alias("log_growth"))


@query(OOS_SQL + """, lv AS (SELECT config_id, fold, t, g, after, sum(g) OVER (PARTITION BY config_id ORDER BY fold, t) AS level FROM days_),
dd AS (SELECT *, exp(level - greatest(max(level) OVER (PARTITION BY config_id ORDER BY fold, t), 0)) - 1 AS depth FROM lv),
cu AS (SELECT config_id, sum(g) AS growth, least(min(depth), 0) AS max_dd, coalesce(stddev_pop(CASE WHEN after AND exp(g) - 1 < 0 THEN exp(g) - 1 END) * sqrt(252), 1e-4) AS down FROM dd GROUP BY 1),
pf AS (SELECT config_id, stddev_pop(r) AS consistency, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS n_folds FROM (SELECT config_id, fold, exp(sum(g)) - 1 AS r FROM days_ GROUP BY 1, 2) GROUP BY 1),
yrs AS (SELECT sum(stop - start) / 252.0 AS years FROM folds)
SELECT cu.config_id, round(growth, 6) AS log_total, round(growth / years, 6) AS log_annualised, round(max_dd, 6) AS max_dd, round(down, 5) AS down, round(win_rate, 6) AS win_rate, n_folds FROM cu JOIN pf ON pf.config_id = cu.config_id, yrs""".replace("\n", " "))
def sim_oos_aggregate(spark, sf_dir):
    """Folds chained per configuration; growth as logarithms, since this panel's totals are beyond what rounding can compare."""
    market, folds, weights = oos_parts(spark, sf_dir)
    out = walkforward.aggregate_folds(kept(walkforward.daily_values(market, weights, folds)), folds)
    return out.select("config_id", r6("growth").alias("log_total"), r6(F.col("growth") / F.col("years")).alias("log_annualised"), r6("max_dd"), F.round("downside", 5).alias("down"), r6("win_rate"), "n_folds")


# --- engines ----------------------------------------------------------------------------------------------------------
def market_with_regime(spark, sf_dir) -> DataFrame:
    """ticker, t, close, calm: whether the equal-weight market's 50-day mean is above its 200-day mean (or not known yet)."""
    rows = universe(spark, sf_dir)
    level = signals.market_level(rows).withColumn("close", F.col("level"))
    calendar = rows.select("date", "t").distinct()
    w = Window.orderBy("t")  # a row a date
    fast, slow = F.avg("close").over(w.rowsBetween(-49, 0)), F.avg("close").over(w.rowsBetween(-199, 0))
    calm = level.join(calendar, "date").select("t", F.when(F.count("close").over(w.rowsBetween(-199, 0)) == 200, fast > slow).otherwise(True).alias("calm"))
    return rows.select("ticker", "t", "close").join(calm, "t")


def engine_grid(spark: SparkSession, plain: bool = False) -> DataFrame:
    """27 configurations: positions x rebalance steps x controls (none, a drawdown stop, a stop with volatility target, regime gate and leverage); `plain` keeps those without controls."""
    i = F.col("id")
    kind = F.floor(i / 9)
    grid = spark.range(27).select(
        i.alias("config_id"),
        (F.lit(3) + i % 3 * 4).cast("int").alias("positions"),
        F.element_at(F.lit([21, 42, 63]), (F.floor(i / 3) % 3 + 1).cast("int")).alias("every"),
        F.lit(WARM).alias("warm"),
        F.lit(0.40).alias("max_share"),
        F.lit(0.03).alias("min_share"),
        F.lit(0.0).alias("min_adv"),
        F.when(kind == 0, -1.0).otherwise(-0.9).alias("floor"),
        F.when(kind == 0, 0.0).otherwise(0.5).alias("stop"),
        F.lit(21).alias("cool"),
        F.when(kind < 2, 0.0).otherwise(0.5).alias("target"),
        F.lit(60).alias("vol_days"),
        F.when(kind < 2, 1.0).otherwise(1.2).alias("leverage"),
        F.lit(0.045).alias("cash_rate"),
        (kind == 2).alias("gated"),
    )
    return grid.where("config_id < 9") if plain else grid


def engine_scores(spark, sf_dir) -> DataFrame:
    return scores_at(spark, sf_dir).select("rt", "ticker", "score", F.round("wt_mom", 8).alias("wt_mom"), "adv60", "current_dd")


@query(None)
def sim_engine(spark, sf_dir):
    """The engine with fixed steps over the whole grid, summed up per configuration."""
    curve = engines.run_fixed_steps(market_with_regime(spark, sf_dir), engine_scores(spark, sf_dir), engine_grid(spark))
    s = risk.curve_summary(curve, ["config_id"], order="step")
    idle = curve.groupBy("config_id").agg(F.avg("idle").alias("in_cash"))
    return s.join(idle, "config_id").select("config_id", "n", r6(F.log1p("total")).alias("log_total"), *[r6(c) for c in ("ulcer", "max_dd", "in_cash")])


@query("@" + ASKED + f""", grid AS (SELECT i AS config_id, 3 + i % 3 * 4 AS positions, [21, 42, 63][(i // 3) % 3 + 1] AS every FROM (SELECT unnest(range(0, 9)) AS i)),
offer AS (SELECT g.config_id, g.every, f.rt, f.ticker, f.score, sum(f.score) OVER (PARTITION BY g.config_id, f.rt) AS total, row_number() OVER (PARTITION BY g.config_id, f.rt ORDER BY score DESC, ticker) AS rank, positions FROM f JOIN grid g ON (rt - {WARM}) % g.every = 0 WHERE round(wt_mom, 8) > 0),
pick AS (SELECT * FROM offer WHERE rank <= positions AND score > 0), cnt AS (SELECT config_id, rt, least(1.0 / count(*), 0.4) AS w, count(*) AS n FROM pick GROUP BY 1, 2),
bound AS (SELECT config_id, rt, lead(rt) OVER (PARTITION BY config_id ORDER BY rt) AS nxt, w, n FROM cnt),
ends AS (SELECT b.config_id, b.rt, coalesce(b.nxt, (SELECT max(t) FROM panel)) AS until, b.w, b.n FROM bound b),
grow AS (SELECT e.config_id, e.rt, ln(sum(e.w * y.close / x.close) + (1 - max(e.w) * max(e.n)) * pow(1.045, (max(e.until) - e.rt) / 252.0)) AS g FROM ends e JOIN pick p ON p.config_id = e.config_id AND p.rt = e.rt JOIN panel x ON x.ticker = p.ticker AND x.t = e.rt JOIN panel y ON y.ticker = p.ticker AND y.t = e.until GROUP BY 1, 2),
lead_ AS (SELECT config_id, min(rt) AS first FROM cnt GROUP BY 1)
SELECT g.config_id, round(sum(g) + (max(first) - {WARM} + 1) * ln(1.045) / 252.0, 6) AS log_total FROM grow g JOIN lead_ l ON l.config_id = g.config_id GROUP BY 1""".replace("\n", " "))
def sim_engine_plain(spark, sf_dir):
    """The same engine without controls, where the SQL can chain holding periods instead of walking days."""
    curve = engines.run_fixed_steps(market_with_regime(spark, sf_dir), engine_scores(spark, sf_dir), engine_grid(spark, plain=True))
    return curve.groupBy("config_id").agg(r6(F.ln(F.max_by("equity", "step") / F.min_by("equity", "step"))).alias("log_total"))


def smoothed(spark, sf_dir) -> DataFrame:
    """The aligned panel with 60-day means for closes: daily weights on single closes would grow beyond what doubles hold."""
    rows = universe(spark, sf_dir).withColumn("close", F.avg("close").over(mom.frame(-59, 0)))
    return rows.withColumn("ret", mom.simple_return()).withColumn("lret", mom.log_return()).persist()


def checked_market(spark, sf_dir) -> DataFrame:
    """ticker, t, close, level, below, scale: the market's level, whether yesterday's is below the mean of the 100 before today, and a factor by the hidden state (states by volatility, calmest last)."""
    rows = smoothed(spark, sf_dir)
    daily = signals.market_level(rows).join(rows.select("date", "t").distinct(), "date").select("t", "level")
    w = Window.orderBy("t")  # a row a date
    mean, vol = F.avg("level").over(w.rowsBetween(-100, -1)), F.stddev_pop("lret").over(w.rowsBetween(-20, 0))
    daily = daily.withColumn("below", F.coalesce(F.lag("level").over(w) < mean, F.lit(False))).withColumn("lret", F.ln(F.col("level") / F.lag("level").over(w)))
    features = daily.select(F.lit("market").alias("ticker"), "t", F.coalesce("lret", F.lit(0.0)).alias("f0"), F.coalesce(vol, F.lit(0.0)).alias("f1"))
    states = hmm.regimes(features).select(F.col("t").cast("int").alias("t"), F.element_at(F.lit([0.5, 0.8, 1.0]), F.col("state").cast("int") + 1).alias("state_scale"))
    scale = F.coalesce(F.last("state_scale", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    daily = daily.join(states, "t", "left").withColumn("scale", scale)
    return rows.select("ticker", "t", "close").join(daily.select("t", "level", "below", "scale"), "t")


def checked_grid(spark: SparkSession) -> DataFrame:
    """18 configurations: triggers x sizings x two sets of controls."""
    i = F.col("id")
    pick = lambda names, k: F.element_at(F.lit(names), (k + 1).cast("int"))
    return spark.range(18).select(
        i.alias("config_id"),
        F.lit(5).alias("positions"),
        F.lit(10).alias("check"),
        F.lit(20).alias("min_hold"),
        F.lit(120).alias("max_hold"),
        F.when(i < 9, 0).otherwise(5).alias("jitter"),
        pick(["fixed", "name_change", "score_gap"], i % 3).alias("trigger"),
        F.lit(0.2).alias("gap"),
        F.when(i < 9, 0.0).otherwise(0.4).alias("stop"),
        (i >= 9).alias("regime"),
        F.when(i < 9, 0.0).otherwise(0.3).alias("target"),
        F.lit(40).alias("vol_days"),
        F.when(i < 9, "off").otherwise("moderate").alias("vol_state"),
        pick(["equal", "score", "sqrt_score"], F.floor(i / 3) % 3).alias("sizing"),
        (i + 42).alias("seed"),
    )


FIRST_CHECK = 294


@query(None)
def sim_engine_checked(spark, sf_dir):
    """The engine with triggers and holds, over its grid, picks from the variant panel with at most two of a capped class; what is not invested is parked in one ticker."""
    rows = smoothed(spark, sf_dir)
    scores = scoring.variant_panel(rows, at=(F.col("t") >= FIRST_CHECK) & ((F.col("t") - FIRST_CHECK) % 10 == 0)).select("t", "ticker", F.round("sortino_pricemom", 8).alias("score")).where("ticker <> 'Brand#25'")
    ranked = scoring.top_with_cap(scores, ["t"], 10**6, F.col("ticker").startswith("Brand#1"), 2).select("t", "ticker", "score", "rank")
    rest = scores.join(ranked, ["t", "ticker"], "left_anti").select("t", "ticker", "score", F.lit(10**6).alias("rank"))
    curve = engines.run_checked(checked_market(spark, sf_dir), ranked.unionByName(rest), checked_grid(spark), FIRST_CHECK, "Brand#25")
    s = risk.curve_summary(curve, ["config_id"], order="step")
    counts = curve.groupBy("config_id").agg(F.max("changes").alias("changes"), F.max("mean_hold").alias("mean_hold"))
    return s.join(counts, "config_id").select("config_id", "n", r6(F.log1p("total")).alias("log_total"), *[r6(c) for c in ("ulcer", "max_dd", "pain", "mean_hold")], "changes")


# --- forward windows --------------------------------------------------------------------------------------------------
def window_grid(spark: SparkSession) -> DataFrame:
    """config_id, variant, every, positions, leverage."""
    i = F.col("id")
    return spark.range(8).select(i.alias("config_id"), F.lit("weeks").alias("variant"), F.when(i % 2 == 0, 10).otherwise(21).alias("every"), F.when(F.floor(i / 2) % 2 == 0, 3).otherwise(6).alias("positions"), F.when(i < 4, 1.0).otherwise(1.3).alias("leverage"))


def weekly_scores(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("weeks").alias("variant"), "t", "ticker", F.round(mom.weeks(), 8).alias("score"))


WEEK = " + ".join(f"0.25 * (close / lag(close, {lb}) OVER w - 1)" for lb in (5, 10, 20, 40))
GROW = "CASE WHEN leverage <= 1 THEN pow(1.045, 1 / 252.0) ELSE pow(1.06, 1 / 252.0) END"
WINDOWS = f"""@wk AS (SELECT ticker, t, round({WEEK}, 8) AS score, close / lag(close, 20) OVER w - 1 AS m4 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t)),
br AS (SELECT t, sum(CASE WHEN m4 > 0 THEN 1 ELSE 0 END) / greatest(count(m4), 1) AS breadth FROM wk GROUP BY t),
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, ticker) AS rank FROM wk WHERE score > 0),
grid AS (SELECT i AS config_id, CASE WHEN i % 2 = 0 THEN 10 ELSE 21 END AS every, CASE WHEN (i // 2) % 2 = 0 THEN 3 ELSE 6 END AS positions, CASE WHEN i < 4 THEN 1.0 ELSE 1.3 END AS leverage FROM (SELECT unnest(range(0, 8)) AS i)),
win AS (SELECT s AS start, least(s + 63, last + 1) AS stop FROM (SELECT max(t) AS last FROM panel), (SELECT unnest(range(46, 100000, 21)) AS s) WHERE least(s + 63, last + 1) - s >= 21),
per AS (SELECT g.*, w.start, w.stop, w.start + k * every AS rt, least(w.start + (k + 1) * every, w.stop - 1) AS until FROM grid g, win w, (SELECT unnest(range(0, 7)) AS k) WHERE w.start + k * every < w.stop),
pk AS (SELECT p.*, rk.ticker FROM per p JOIN br ON br.t = p.rt AND breadth >= 0.30 JOIN rk ON rk.t = p.rt AND rk.rank <= p.positions),
hl AS (SELECT pk.config_id, pk.start, pk.rt, pk.rt + a AS t, avg(y.close / x.close) AS held FROM pk CROSS JOIN (SELECT unnest(range(0, 22)) AS a) JOIN panel x ON x.ticker = pk.ticker AND x.t = pk.rt JOIN panel y ON y.ticker = pk.ticker AND y.t = pk.rt + a WHERE pk.rt + a <= pk.until GROUP BY 1, 2, 3, 4),
dy AS (SELECT p.*, p.rt + a AS t FROM per p CROSS JOIN (SELECT unnest(range(0, 22)) AS a) WHERE p.rt + a <= p.until),
mk AS (SELECT p.*, p.t - p.rt AS age, held, greatest(CASE WHEN held IS NULL THEN pow(1.045, (p.t - p.rt) / 252.0) ELSE (1 - leverage * 0.0005) * (leverage * held + (1 - leverage) * pow({GROW}, p.t - p.rt)) END, 1e-12) AS closing,
  greatest(CASE WHEN held IS NULL THEN pow(1.045, greatest(p.t - p.rt - 1, 0) / 252.0) ELSE (1 - leverage * 0.0005) * (leverage * held + (1 - leverage) * pow({GROW}, greatest(p.t - p.rt - 1, 0))) END, 1e-12) AS mark
  FROM dy p LEFT JOIN hl ON hl.config_id = p.config_id AND hl.start = p.start AND hl.rt = p.rt AND hl.t = p.t),
bs AS (SELECT config_id, start, rt, pow(1.045, 1 / 252.0) * exp(coalesce(sum(ln(closing)) OVER (PARTITION BY config_id, start ORDER BY rt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS base FROM mk WHERE t = until),
cv AS (SELECT m.config_id, m.start, m.t - m.start AS day, CASE WHEN m.t = m.start THEN 1.0 ELSE base * mark END AS equity, CASE WHEN m.t = m.start OR held IS NULL THEN 1.0 ELSE 0.0 END AS idle FROM mk m JOIN bs ON bs.config_id = m.config_id AND bs.start = m.start AND bs.rt = m.rt WHERE age > 0 OR m.t = m.start
  UNION ALL SELECT m.config_id, m.start, m.stop - m.start, base * closing, NULL FROM mk m JOIN bs ON bs.config_id = m.config_id AND bs.start = m.start AND bs.rt = m.rt WHERE m.t = m.stop - 1 AND m.t = m.until),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY config_id, start ORDER BY day) - 1 AS d FROM cv),
rs AS (SELECT config_id, start, arg_max(equity, day) - 1 AS ret, sqrt(avg(d * d)) AS ulcer, min(d) AS max_dd, avg(idle) AS in_cash FROM dd GROUP BY 1, 2)"""


def windows(spark, sf_dir) -> DataFrame:
    rows = universe(spark, sf_dir)
    last = rows.agg(F.max("t").alias("last"))
    starts = last.select(F.explode(F.sequence(F.lit(46), F.col("last"), F.lit(21))).alias("start"))
    breadth = rows.withColumn("m", mom.no_skip(20)).groupBy("t").agg((F.sum(F.when(F.col("m") > 0, 1).otherwise(0)) / F.greatest(F.count("m"), F.lit(1))).alias("breadth"))
    return walkforward.forward_windows(rows, weekly_scores(rows), breadth, window_grid(spark), starts)


@query(WINDOWS + " SELECT config_id, start, round(ret, 6) AS ret, round(ulcer, 6) AS ulcer, round(max_dd, 6) AS max_dd, round(in_cash, 6) AS in_cash FROM rs")
def sim_forward_windows(spark, sf_dir):
    return windows(spark, sf_dir).select("config_id", "start", r6("ret"), r6("ulcer"), r6("max_dd"), r6("in_cash"))


@query(WINDOWS + " SELECT config_id, count(*) AS n_windows, " + ", ".join(f"round(quantile_cont(ret, {q / 100}), 6) AS p{q}_ret" for q in (10, 25, 50, 75, 90)) + ", round(avg(ret), 6) AS mean_ret, round(quantile_cont(ulcer, 0.5), 6) AS p50_ulcer, round(quantile_cont(max_dd, 0.25), 6) AS p25_max_dd, round(quantile_cont(max_dd, 0.5), 6) AS p50_max_dd, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM rs GROUP BY 1")
def sim_forward_summary(spark, sf_dir):
    out = walkforward.window_summary(windows(spark, sf_dir))
    return out.select("config_id", "n_windows", *[r6(c) for c in out.columns[2:]])


@query("@wk AS (SELECT ticker, t, close, round(" + WEEK + ", 8) AS score, close / lag(close, 20) OVER w - 1 AS m4 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t)), n AS (SELECT * FROM wk WHERE t = (SELECT max(t) FROM panel)), b AS (SELECT sum(CASE WHEN m4 > 0 THEN 1 ELSE 0 END) / greatest(count(m4), 1) AS breadth FROM n), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS rank FROM n WHERE score > 0) SELECT ticker, rank, CAST(floor(100000.0 / (SELECT count(*) FROM k WHERE rank <= 5) / close) AS BIGINT) AS shares FROM k, b WHERE rank <= 5 AND breadth >= 0.30")
def sim_tactical_picks(spark, sf_dir):
    """Live picks by weekly momentum in whole shares; none while breadth is low."""
    rows = universe(spark, sf_dir)
    last = rows.agg(F.max("t").alias("t"))
    scored = rows.select("ticker", "t", "close", F.round(mom.weeks(), 8).alias("score"), mom.no_skip(20).alias("m")).join(F.broadcast(last), "t")  # one row
    wide = scored.agg((F.sum(F.when(F.col("m") > 0, 1).otherwise(0)) / F.greatest(F.count("m"), F.lit(1))).alias("breadth")).where("breadth >= 0.30")
    picks = scoring.top(scored.where("score > 0"), ["t"], 5).join(F.broadcast(wide), how="cross")  # one row or none
    out = allocation.whole_shares(picks.withColumn("capital", F.lit(100_000.0)), ["t"], "capital", "close")
    return out.select("ticker", "rank", "shares")

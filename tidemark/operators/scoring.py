"""Scoring tickers: every measure of the ticker scorer as windows over a ticker's own days, scores from momentum variants and switches, and ranks across tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import momentum as mom
from tidemark.operators import risk, signals
from tidemark.operators.momentum import back, frame
from tidemark.operators.prep import so_far
from tidemark.sources.panel import by_ticker

#: Days of its own that a ticker must have to be scored.
LEAST_DAYS = 84
SKIP, YEAR = 21, 252

#: The scorer's numbers, in order.
OUTPUTS = [
    "mom_1m", "mom_3m", "mom_6m", "mom_12m", "wt_mom", "quality", "fip", "smoothness", "dn_vol", "score", "score_pricemom", "score_sortino", "score_martin", "score_12_1",
    "wtmf_composite", "score_wtmf", "baltas_slope", "baltas_tstat", "score_baltas", "ulcer_1y", "max_dd_1y", "martin", "max_dd", "max_dd_dur", "avg_dd_dur", "current_dd", "worst_3m_dd",
    "dist52", "dv_slope", "adv60", "vol_factor", "high_factor", "latest_price",
]


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def measures(panel: DataFrame) -> DataFrame:
    """The scorer's windowed measures at every own day of every ticker: all but those of the restarting year.

    `panel`: ticker, t (number of the ticker's own day), close, ret, dvol and what
    else is to pass. All windows share one partitioning and order, so the rows are
    shuffled and sorted once.
    """
    span = frame(-(SKIP + YEAR - 1), -SKIP)
    lnp, x = F.ln("close"), F.col("t").cast("double")
    fit = {k: getattr(F, f"regr_{k}")(lnp, x).over(span) for k in ("slope", "sxx", "syy", "sxy", "count")}
    residual = F.greatest(fit["syy"] - F.try_divide(fit["sxy"] * fit["sxy"], fit["sxx"]), F.lit(0.0))
    rows = panel.select("*", *[mom.skip_short(lb).alias(k) for lb, k in ((21, "mom_1m"), (63, "mom_3m"), (126, "mom_6m"), (252, "mom_12m"))], signals.downside("dnv_hist_neg").alias("dn_vol"))
    rows = rows.select("*", fit["slope"].alias("slope"), fit["sxx"].alias("sxx"), fit["syy"].alias("syy"), fit["count"].alias("points"), residual.alias("residual"))
    rows = rows.withColumn("fip", F.coalesce(F.avg((F.col("ret") > 0).cast("double")).over(frame(-(SKIP + YEAR - 2), -(SKIP - 1))), F.lit(0.5)))
    # depth and spells below the high
    rows = rows.withColumn("current_dd", risk.drawdown()).withColumn("under", F.col("current_dd") < 0)
    rows = rows.withColumn("max_dd", F.min("current_dd").over(so_far())).withColumn("depth_3m", risk.depth_in(63))
    rows = rows.withColumn("worst_3m_dd", F.when(F.col("t") > 63, F.min("depth_3m").over(by_ticker().rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.col("max_dd")))
    rows = rows.withColumn("last_high", F.max(F.when(~F.col("under"), F.col("t"))).over(so_far())).withColumn("spell", F.when(F.col("under"), F.col("t") - F.col("last_high")).otherwise(0))
    rows = rows.withColumn("max_dd_dur", F.max("spell").over(so_far())).withColumn("spells", F.sum((F.col("spell") == 1).cast("long")).over(so_far()))
    rows = rows.withColumn("avg_dd_dur", _or_zero(F.try_divide(F.sum(F.col("under").cast("long")).over(so_far()), F.col("spells"))))
    # volume and level
    rows = rows.withColumn("dist52", F.when(F.col("t") >= YEAR, signals.below_high()))
    quarter = frame(-62, 0)
    traded = F.when(F.col("dvol") > 0, F.ln("dvol"))
    rows = rows.withColumn("known", F.sum(F.when(F.col("dvol") > 0, 1).otherwise(0)).over(so_far()).cast("double"))
    enough = (F.col("t") >= 63) & (F.count(traded).over(quarter) >= 30)
    rows = rows.withColumn("dv_slope", _or_zero(F.when(enough, F.regr_slope(traded, F.col("known")).over(quarter) * YEAR)))
    return rows.withColumn("adv60", F.when(F.col("t") >= 60, F.avg("dvol").over(frame(-59, 0))).otherwise(0.0)).drop("under", "depth_3m", "last_high", "spell", "spells", "known")


def scored(rows: DataFrame) -> DataFrame:
    """The scores of rows that have measures() and ulcer_1y, max_dd_1y: plain projections."""
    c = F.col
    over = lambda x: F.when(c("dn_vol") > 0, x / c("dn_vol")).otherwise(0.0)
    rows = rows.withColumn("wt_mom", 0.2 * c("mom_3m") + 0.4 * c("mom_6m") + 0.4 * c("mom_12m"))
    rows = rows.withColumn("quality", F.when((c("points") >= 20) & (c("syy") > 0), F.greatest(1 - c("residual") / c("syy"), F.lit(0.0))).otherwise(0.0))
    error = F.sqrt(F.try_divide(c("residual"), c("points") - 2)) / F.sqrt("sxx")
    rows = rows.withColumn("baltas_slope", F.when(c("points") >= 20, c("slope") * YEAR).otherwise(0.0)).withColumn("baltas_tstat", _or_zero(F.when((c("points") >= 20) & (error > 0), F.try_divide(c("slope"), error))))
    rows = rows.withColumn("smoothness", F.sqrt(c("quality") * c("fip"))).withColumn("score_pricemom", over(c("wt_mom") * c("smoothness"))).withColumn("score_12_1", over(c("mom_12m") * c("smoothness")))
    rows = rows.withColumn("score_baltas", over(F.when(F.abs("baltas_tstat") > 1.5, c("baltas_slope")).otherwise(0.0) * c("quality")))
    rows = rows.withColumn("wtmf_composite", F.signum("mom_3m") + F.signum("mom_6m") + F.signum("mom_12m")).withColumn("score_wtmf", over(F.abs("wtmf_composite") / 3 * c("wt_mom") * c("smoothness")))
    rows = rows.withColumn("martin", F.when(c("ulcer_1y") > 0.001, c("wt_mom") / c("ulcer_1y")).otherwise(0.0))
    rows = rows.withColumn("vol_factor", signals.volume_factor(c("dv_slope"))).withColumn("high_factor", signals.level_factor(c("dist52")))
    rows = rows.withColumn("score_sortino", c("score_pricemom") * c("vol_factor") * c("high_factor")).withColumn("score_martin", c("martin") * c("smoothness") * c("vol_factor") * c("high_factor"))
    return rows.withColumn("score", c("score_martin")).withColumn("latest_price", c("close"))


def score_table(panel: DataFrame, at: DataFrame) -> DataFrame:
    """OUTPUTS for each (ticker, t) of `at` (t: the ticker's own day), where the ticker has LEAST_DAYS. Measures are windows over all rows; the restarting year joins only the rows asked for."""
    wanted = at.where(F.col("t") >= LEAST_DAYS).distinct()
    year = risk.restarting(panel, wanted.select("ticker", F.col("t").alias("rt")), YEAR).select("ticker", F.col("rt").alias("t"), F.col("ulcer").alias("ulcer_1y"), F.col("max_dd").alias("max_dd_1y"))
    rows = measures(panel).join(year, ["ticker", "t"])
    return scored(rows).select("ticker", "t", *OUTPUTS)


def as_of(aligned: DataFrame, dates: DataFrame) -> DataFrame:
    """(ticker, rt, t) for each calendar number rt of `dates`: the ticker's last own day by then."""
    return aligned.join(dates.select(F.col("t").alias("rt")), F.col("t") == F.col("rt")).select("ticker", "rt", F.col("n").alias("t"))


def percentile_rank(name: str, keys: list[str], high: bool = True) -> Column:
    """0 for the worst to 1 for the best within `keys`, ties averaged; NULL ranks as NULL and counts for none of the others."""
    w = Window.partitionBy(*keys)
    order = F.col(name).asc_nulls_last() if high else F.col(name).desc_nulls_last()
    ties = F.count("*").over(Window.partitionBy(*keys, name))
    place = F.rank().over(w.orderBy(order)) + (ties - 1) / 2.0
    return F.when(F.col(name).isNotNull(), (place - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


#: The factors of the rank score, and whether more is better.
FACTORS = [("wt_mom", True), ("smoothness", True), ("ulcer_1y", False), ("dv_slope", True), ("dist52", False)]


def rank_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """score_rank: the mean of five percentile ranks among rows of positive momentum within `keys`; 0 for the others and where a factor is NULL."""
    up = scores.withColumn("__up", F.coalesce(F.col("wt_mom") > 0, F.lit(False)))
    total = F.lit(0.0)
    for name, high in FACTORS:
        total = total + percentile_rank(name, [*keys, "__up"], high)
    return up.withColumn("score_rank", F.coalesce(F.when(F.col("__up"), total / len(FACTORS)), F.lit(0.0))).drop("__up")


def top(rows: DataFrame, keys: list[str], n: int | Column, score: str = "score") -> DataFrame:
    """The n best of each group by score, ties by ticker, with `rank`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "ticker")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_with_cap(rows: DataFrame, keys: list[str], n: int, capped: Column, cap: int, score: str = "score") -> DataFrame:
    """The n best positive scores, of which at most `cap` are of the capped class."""
    rows = rows.where(F.col(score) > 0).withColumn("__capped", capped)
    own = F.row_number().over(Window.partitionBy(*keys, "__capped").orderBy(F.desc(score), "ticker"))
    return top(rows.withColumn("__own", own).where(~F.col("__capped") | (F.col("__own") <= cap)), keys, n, score).drop("__capped", "__own")


#: Momentum over a lookback by the name of its variant.
VARIANTS = {
    "none": mom.skip_short,
    "basic": lambda lb, skip: _or_zero(mom.log_momentum(lb, skip)),
    "ewma": lambda lb, skip: _or_zero(mom.ewma_log_momentum(lb, skip)),
    "volnorm": lambda lb, skip: _or_zero(mom.volnorm_log_momentum(lb, skip)),
    "accel": lambda lb, skip: _or_zero(mom.acceleration(lb, skip)),
    "trimmed": lambda lb, skip: _or_zero(mom.trimmed_log_momentum(lb, skip)),
}


def signal_cache(aligned: DataFrame, pairs: list[tuple[int, int]], variants: list[str]) -> DataFrame:
    """What a switched score needs, at every day of the aligned panel: one column m_<variant>_<lookback>_<skip> for each, and the filters. Only what is named is computed; Catalyst drops what a query leaves out."""
    rows = aligned
    for variant in variants:
        for lb, skip in pairs:
            rows = rows.withColumn(f"m_{variant}_{lb}_{skip}", VARIANTS[variant](lb, skip))
    market = Window.orderBy("t")
    daily = aligned.groupBy("t").agg(F.avg("close").alias("p"))  # a row a date before the one ordered window
    fall, rise = F.try_divide(F.col("p"), F.lag("p", 504).over(market)) - 1 < 0, F.try_divide(F.col("p"), F.lag("p", 21).over(market)) - 1 > 0.05
    crash = daily.select("t", F.when(fall & rise, 0.5).otherwise(1.0).alias("crash"))
    rows = rows.withColumn("smooth", signals.smoothness()).withColumn("dn", F.greatest(signals.downside("dnv_252_clip0"), F.lit(1e-4))).withColumn("tv", signals.total_vol())
    first = F.first("close").over(frame(-252, 0))
    rows = rows.withColumn("steady", signals.consistent().cast("double")).withColumn("abs12", _or_zero(F.try_divide(F.col("close"), first) - 1))
    return rows.join(crash, "t")


def switched(cache: DataFrame, momentum: Column, flags: Column, earnings: Column | None = None) -> Column:
    """The score of one row under a configuration: weighted momentum, times or over what `flags` (a map of booleans) switches on; -1 where the momentum is not positive, or by dual momentum the year's return is not."""
    on = lambda name: F.coalesce(flags[name], F.lit(False))
    score = momentum
    score = score * F.when(on("smooth"), F.col("smooth")).otherwise(1.0)
    score = score / F.when(on("sortino"), F.col("dn")).otherwise(1.0)
    if earnings is not None:
        score = score * F.when(on("earnings"), 1 + F.least(F.greatest(_or_zero(earnings), F.lit(-0.5)), F.lit(2.0))).otherwise(1.0)
    score = score * F.when(on("consistent"), F.col("steady")).otherwise(1.0)
    score = F.when(on("dual") & ~(F.col("abs12") > 0), -1.0).otherwise(score)
    score = score * F.when(on("crash"), F.col("crash")).otherwise(1.0)
    return F.when(momentum > 0, score).otherwise(-1.0)


def _panel_parts(lookbacks, weights, skip: int, depth: int) -> tuple[Column, Column, Column]:
    """Blend, downside and whole volatility from rows before the row only; volatilities end at the skip."""
    span = frame(-(depth + skip), -(skip + 1))
    down = F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).over(span) * F.sqrt(F.lit(252.0))
    whole = F.stddev_pop("ret").over(span) * F.sqrt(F.lit(252.0))
    safe = lambda v: F.when(v > 0, v).otherwise(1e-4)
    return mom.available_blend(lookbacks, weights, skip), safe(down), safe(whole)


def variant_panel(panel: DataFrame, lookbacks=(63, 126, 252), weights=(0.2, 0.4, 0.4), skip: int = SKIP, depth: int = YEAR, at: Column | None = None) -> DataFrame:
    """The five score variants at the rows `at` (default: every row), from rows before them: by downside volatility alone, by both volatilities, weighted by the signs' agreement, the trend's slope, and by the ulcer of a restarting window.

    NULL where history is short. The last joins each row with its own window, the others are windows.
    """
    longest, least = max(lookbacks), min(lookbacks)
    blend, down, whole = _panel_parts(lookbacks, weights, skip, depth)
    long = depth + longest + skip
    wide, steps = frame(-long, -1), frame(-(long - 1), -1)
    all_down = F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).over(steps) * F.sqrt(F.lit(252.0))
    signs = sum((F.coalesce(F.signum(mom.previous_bar(lb, skip)), F.lit(0.0)) for lb in lookbacks), F.lit(0.0))
    rows = panel.select("ticker", "t", "close", "ret", blend.alias("blend"), down.alias("down"), whole.alias("whole"), signs.alias("signs"), (F.regr_slope(F.ln("close"), F.col("t").cast("double")).over(wide) * YEAR).alias("slope"), F.coalesce(all_down, F.lit(1e-4)).alias("all_down"), F.count("*").over(wide).alias("before"), back("close", skip + least).alias("nearest"))
    rows = rows if at is None else rows.where(at)
    ended = rows.where(F.col("before") >= long).select("ticker", (F.col("t") - 1).alias("rt"))
    ulcer = risk.restarting(panel, ended, long).select("ticker", (F.col("rt") + 1).alias("t"), "ulcer")
    rows = rows.where(F.col("nearest").isNotNull() & F.col("blend").isNotNull()).join(ulcer, ["ticker", "t"], "left")
    known = F.col("before") >= long
    return rows.select(
        "ticker",
        "t",
        (F.col("blend") / F.col("down")).alias("sortino_pricemom"),
        (F.col("blend") / F.col("whole") / F.col("down")).alias("sortino_vnorm"),
        (F.abs("signs") / 3 * F.col("blend") / F.col("down")).alias("wtmf"),
        F.when(known, F.when(F.col("all_down") > 0, F.col("slope") / F.col("all_down")).otherwise(0.0)).alias("baltas"),
        F.when(known, F.col("blend") / F.greatest(F.col("ulcer"), F.lit(1e-3))).alias("martin"),
    )

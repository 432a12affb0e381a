"""Drawdown and performance measures. Depths are <= 0; thresholds of the ratios are parameters, as they differ between reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.panel import by_ticker

YEAR = 252


def drawdown(name: str = "close") -> Column:
    return F.try_divide(F.col(name), F.max(name).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))) - 1


def restarting(panel: DataFrame, at: DataFrame, n: int = 252) -> DataFrame:
    """Ulcer index and worst drawdown of the n rows up to each (ticker, rt), the maximum restarting in each window.

    The range join is an equi-join on blocks of n rows: a window meets its own
    block and the one before. A window's rows are then one group of n.
    """
    prices = panel.select("ticker", "t", "close", F.floor(F.col("t") / n).alias("block"))
    spans = at.select(F.col("ticker"), F.col("rt"), F.explode(F.array(F.floor(F.col("rt") / n), F.floor(F.col("rt") / n) - 1)).alias("block"))
    rows = prices.join(spans, ["ticker", "block"]).where((F.col("t") > F.col("rt") - n) & (F.col("t") <= F.col("rt")))
    w = Window.partitionBy("ticker", "rt").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("dd", F.col("close") / F.max("close").over(w) - 1)
    return rows.groupBy("ticker", "rt").agg(F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), F.min("dd").alias("max_dd"), F.count("*").alias("n"))


def depth_in(n: int, name: str = "close") -> Column:
    """The row's depth below the highest of the n rows up to it. Its least value over some rows is the worst drawdown inside any window of n rows among them."""
    return F.try_divide(F.col(name), F.max(name).over(by_ticker().rowsBetween(-(n - 1), 0))) - 1


def curve_summary(curve: DataFrame, keys: list[str], value: str = "equity", order: str = "t") -> DataFrame:
    """Total, CAGR (points / 252 years), Sharpe, ulcer, pain, Martin ratio and worst drawdown of each curve."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = curve.withColumn("r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
    rows = rows.withColumn("dd", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("vol"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"),
        F.avg(F.abs("dd")).alias("pain"),
        F.min("dd").alias("max_dd"),
    )
    cagr = F.pow(F.try_divide(F.col("last"), F.col("first")), F.lit(float(YEAR)) / F.col("n")) - 1
    out = out.withColumn("total", F.try_divide(F.col("last"), F.col("first")) - 1).withColumn("cagr", cagr)
    out = out.withColumn("sharpe", F.try_divide(F.col("mean"), F.col("vol")) * YEAR**0.5)
    return out.withColumn("martin", F.when(F.col("ulcer") > 1e-6, F.col("cagr") / F.col("ulcer"))).withColumn("calmar", F.when(F.col("max_dd") < -1e-4, F.col("cagr") / -F.col("max_dd")))


def underwater_spells(panel: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per ticker the number, longest and mean length of runs of rows with drawdown below the threshold: gaps and islands."""
    under = panel.withColumn("under", drawdown() < threshold)
    flips = under.withColumn("island", F.sum(F.when(F.col("under") != F.coalesce(F.lag("under").over(by_ticker()), ~F.col("under")), 1).otherwise(0)).over(by_ticker()))
    runs = flips.where("under").groupBy("ticker", "island").agg(F.count("*").alias("len"))
    return runs.groupBy("ticker").agg(F.count("*").alias("spells"), F.max("len").alias("longest"), F.avg("len").alias("mean_len"))


def tail_risk(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Value at risk at 95 and 99, the mean beyond the first, shares of losses and gains."""
    p = frame.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.expr(f"percentile({name}, array(0.05, 0.01))").alias("p"))
    rows = frame.where(F.col(name).isNotNull()).join(p, keys)
    return rows.groupBy(*keys).agg(
        F.first("p")[0].alias("var95"),
        F.first("p")[1].alias("var99"),
        F.avg(F.when(F.col(name) <= F.col("p")[0], F.col(name))).alias("cvar95"),
        F.avg((F.col(name) < 0).cast("double")).alias("loss_share"),
        F.avg((F.col(name) > 0).cast("double")).alias("gain_share"),
    )


def correlations(panel: DataFrame, name: str = "ret") -> DataFrame:
    """Every ordered pair of tickers on common dates; NULL for a constant side."""
    a = panel.select(F.col("ticker").alias("a"), "date", F.col(name).alias("x"))
    b = panel.select(F.col("ticker").alias("b"), "date", F.col(name).alias("y"))
    both = a.join(b, "date").where("x is not null and y is not null")
    return both.groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))


def underwater_penalty(months: Column) -> Column:
    """1 up to a year, falling to 0.4 at two years and 0.03 at three."""
    return F.when(months <= 12, 1.0).when(months <= 24, 1.0 - 0.6 * (months - 12) / 12).when(months <= 36, 0.4 - 0.37 * (months - 24) / 12).otherwise(0.03)


def nerve_penalty(depth: Column, months: Column) -> Column:
    """Depth times years under water: free to 0.10, 0.5 at 0.50, 0.05 from 0.80 on."""
    load = F.abs(depth) * months / 12
    return F.when(load <= 0.10, 1.0).when(load <= 0.50, 1.0 - 0.5 * (load - 0.10) / 0.40).when(load <= 0.80, 0.5 - 0.45 * (load - 0.50) / 0.30).otherwise(0.05)


def composite_score(pain_ratio: Column, cagr: Column, months: Column, depth: Column, tail: Column, win: Column, rebalances: Column) -> Column:
    """Pain ratio x CAGR ramp x underwater x nerve x tail x win rate; -1 for losers and under three rebalances. The win-rate factor drops from 1.0 to 0.8 on reaching one half."""
    ramp = F.when(cagr < 0.10, 0.0).when(cagr < 0.25, (cagr - 0.10) / 0.15).otherwise(1.0 + F.least(F.lit(0.4), (cagr - 0.25) / 0.50))
    winning = F.when(win < 0.5, 0.5 + win).otherwise(1.0 + F.least(F.lit(0.3), win - 0.7))
    score = pain_ratio * ramp * underwater_penalty(months) * nerve_penalty(depth, months) * (1.0 - tail) * winning
    return F.when((rebalances < 3) | (cagr <= 0) | (pain_ratio <= 0), -1.0).otherwise(score)


def strategy_stats(curve: DataFrame, keys: list[str], value: str, order: str, per_year: int, risk_free: float) -> DataFrame:
    """CAGR over the steps, sample volatility, Sharpe and Sortino over a risk-free rate, worst drawdown and Calmar of curves with a point a period."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = curve.withColumn("r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).withColumn("dd", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    root = F.sqrt(F.lit(float(per_year)))
    g = rows.groupBy(*keys).agg(F.count("r").alias("n"), (F.max_by(value, order) / F.min_by(value, order)).alias("growth"), (F.stddev_samp("r") * root).alias("risk"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * root).alias("down"), F.min("dd").alias("max_dd"))
    g = g.withColumn("cagr", F.pow("growth", F.lit(float(per_year)) / F.col("n")) - 1)
    over = lambda x: F.try_divide(F.col("cagr") - risk_free, x)
    return g.withColumn("sharpe", over(F.col("risk"))).withColumn("sortino", over(F.col("down"))).withColumn("calmar", F.try_divide(F.col("cagr"), -F.col("max_dd"))).drop("growth", "down")


def pain_report(panel: DataFrame) -> DataFrame:
    """Per ticker: worst and current depth, the spread of calendar months, share of losing ones, yearly return and volatility."""
    depth = panel.withColumn("dd", drawdown()).groupBy("ticker").agg(F.min("dd").alias("max_dd"), F.max_by("dd", "t").alias("current_dd"), (F.pow(F.max_by("close", "t") / F.min_by("close", "t"), F.lit(float(YEAR)) / F.count("*")) - 1).alias("cagr"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR)))).alias("vol"))
    months = panel.groupBy("ticker", F.trunc("date", "month").alias("m")).agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"))
    spread = months.groupBy("ticker").agg(F.expr("percentile(r, array(0.05, 0.5, 0.95))").alias("p"), F.avg((F.col("r") < 0).cast("double")).alias("losing"))
    return depth.join(spread.select("ticker", *[F.col("p")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "losing"), "ticker")


def rank_sum(rows: DataFrame, name: str, measures: dict[str, bool]) -> DataFrame:
    """(name, rank_sum): places by each measure (True: more is better) summed; a missing value takes the last places. A row a fund."""
    total = F.lit(0)
    for measure, high in measures.items():
        value = F.coalesce(F.col(measure), F.lit(-999.0 if high else 999.0))
        total = total + F.row_number().over(Window.orderBy(value.desc() if high else value.asc(), name))
    return rows.select(name, total.cast("long").alias("rank_sum"))


def rolling_correlations(panel: DataFrame, n: int, name: str = "ret") -> DataFrame:
    """(a, b, t, c) over the last n common days of every pair of tickers a < b, where there are n; NULL for a constant side."""
    a = panel.select(F.col("ticker").alias("a"), "t", F.col(name).alias("x"))
    b = panel.select(F.col("ticker").alias("b"), "t", F.col(name).alias("y"))
    w = Window.partitionBy("a", "b").orderBy("t").rowsBetween(-(n - 1), 0)
    rows = a.join(b, "t").where("a < b AND x IS NOT NULL AND y IS NOT NULL").withColumn("k", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("c", F.try_divide(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w)))
    return rows.where(F.col("k") == n).select("a", "b", "t", "c")


def weighted_portfolio(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: yearly mean and volatility, Sharpe, Sortino and worst drawdown of weights (ticker, w) brought to a sum of one over the tickers of each day."""
    daily = panel.join(weights, "ticker").groupBy("t").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("r"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    rows = daily.withColumn("level", F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(w))
    rows = rows.withColumn("dd", F.exp(F.col("level") - F.greatest(F.max("level").over(w), F.lit(0.0))) - 1)
    g = rows.agg(F.count("*").alias("n"), (F.avg("r") * YEAR).alias("mean"), (F.stddev_samp("r") * F.sqrt(F.lit(float(YEAR)))).alias("vol"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * F.sqrt(F.lit(float(YEAR)))).alias("down"), F.min("dd").alias("max_dd"))
    return g.withColumn("sharpe", F.try_divide(F.col("mean"), F.col("vol"))).withColumn("sortino", F.try_divide(F.col("mean"), F.col("down")))

"""Walk-forward periods as relations: configurations share the scores of their signature, weights meet returns, and folds are chained by sums of logarithms. Nothing here depends on its own equity, so nothing is sequential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.allocation import haven_split
from tidemark.operators.simulation import held_prices, trade_cost

YEAR = 252


def rebalance_days(folds: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(fold, frequency, k, rt, until) of every fold (fold, start, stop; 0-based) and frequency, in the panel's 1-based numbers."""
    rows = folds.crossJoin(frequencies.select("frequency").distinct())  # folds and frequencies are some dozens
    steps = F.sequence(F.lit(0), (F.col("stop") - F.col("start") - 1).cast("int"), F.col("frequency").cast("int"))
    rows = rows.select("fold", "start", "stop", "frequency", F.posexplode(steps).alias("k", "offset"))
    return rows.select("fold", "frequency", "k", (F.col("start") + F.col("offset") + 1).alias("rt"), F.least(F.col("start") + F.col("offset") + F.col("frequency"), F.col("stop")).alias("until")).withColumn("until", F.col("until") + 1)


def weights(scores: DataFrame, grid: DataFrame, days: DataFrame, havens: DataFrame | None = None) -> DataFrame:
    """(config_id, fold, k, rt, until, ticker, w).

    scores: signature, t, ticker, score, tv, abs12; grid: config_id, signature,
    positions, frequency, dual, volscale. A signature is ranked once for all its
    configurations: sizes and frequencies join the ranked rows.
    """
    most = grid.groupBy("signature").agg(F.max("positions").alias("most"))
    live = scores.where("score > 0")
    if havens is not None:
        live = live.join(havens, "ticker", "left_anti")
    order = Window.partitionBy("signature", "t").orderBy(F.desc("score"), "ticker")
    ranked = live.withColumn("rank", F.row_number().over(order)).join(most, "signature").where(F.col("rank") <= F.col("most"))
    groups = grid.join(days, "frequency").select("config_id", "signature", "fold", "k", "rt", "until", "positions", "dual", "volscale")
    keys = ["config_id", "fold", "k", "rt", "until"]
    chosen = groups.join(ranked.withColumnRenamed("t", "rt"), ["signature", "rt"]).where(F.col("rank") <= F.col("positions")).select(*keys, "ticker", "tv")
    if havens is None:
        rest = chosen.select(*keys, "ticker", F.lit(0.0).alias("abs12")).limit(0)
    else:
        safe = scores.join(havens, "ticker", "left_semi").select("signature", F.col("t").alias("rt"), "ticker", "abs12")
        rest = groups.where("dual").join(safe, ["signature", "rt"]).select(*keys, "ticker", "abs12")
    return haven_split(chosen, rest, groups.select(*keys, "positions", "dual", "volscale"), keys)


def costs(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(config_id, fold, k, cost): of turnover against the weights of the rebalance before, with tax on the gain since the holding spell began. Rebalances into nothing cost nothing and end all spells."""
    keys = ["config_id", "fold"]
    own = Window.partitionBy(*keys, "ticker").orderBy("k")
    held = weights.where("w > 0").withColumn("spell", F.col("k") - F.row_number().over(own))
    held = held.withColumn("since", F.min("rt").over(Window.partitionBy(*keys, "ticker", "spell")))
    after = held.select(*keys, "ticker", (F.col("k") + 1).alias("k"), F.col("w").alias("old"), "since")
    active = weights.select(*keys, "k", "rt").distinct()
    both = held.select(*keys, "ticker", "k", F.col("w").alias("new")).join(after, [*keys, "ticker", "k"], "full_outer").join(active, [*keys, "k"])
    price = panel.select("ticker", F.col("t").alias("rt"), F.col("close").alias("now"))
    entry = panel.select("ticker", F.col("t").alias("since"), F.col("close").alias("paid"))
    both = both.join(price, ["ticker", "rt"]).join(entry, ["ticker", "since"], "left")
    change = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    gain = F.greatest(F.coalesce(F.try_divide(F.col("now"), F.col("paid")) - 1, F.lit(0.0)), F.lit(0.0))
    return both.groupBy(*keys, "k").agg(trade_cost(F.abs(change), F.greatest(-change, F.lit(0.0)) * gain).alias("cost"))


def daily_values(panel: DataFrame, weights: DataFrame, folds: DataFrame) -> DataFrame:
    """(config_id, fold, t, g): the logarithm of each day's growth in each fold, costs taken off on rebalance days (all, where they are more than there is); a fold's first row (t = its start) carries the first cost. Days in nothing grow by nothing and are left out."""
    rows = held_prices(panel, weights, "ret")
    days = rows.groupBy("config_id", "fold", "t").agg(F.ln(F.greatest(1 + F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))), F.lit(1e-12))).alias("g"))
    paid = weights.select("config_id", "fold", "k", "rt").distinct().join(costs(panel, weights), ["config_id", "fold", "k"]).select("config_id", "fold", F.col("rt").alias("t"), F.ln(F.greatest(1 - F.col("cost"), F.lit(1e-12))).alias("g"))
    return days.unionByName(paid).groupBy("config_id", "fold", "t").agg(F.sum("g").alias("g"))


def fold_results(days: DataFrame, folds: DataFrame) -> DataFrame:
    """(config_id, fold, growth, ret) from the fold's start, whose first cost is in its base and so not in its return; growth is the logarithm of 1 + ret."""
    begin = folds.select("fold", (F.col("start") + 1).alias("first"))
    rows = days.join(F.broadcast(begin), "fold")  # some dozens of folds
    per = rows.groupBy("config_id", "fold").agg(F.sum(F.when(F.col("t") > F.col("first"), F.col("g")).otherwise(0.0)).alias("growth"))
    return per.withColumn("ret", F.exp("growth") - 1)


def aggregate_folds(days: DataFrame, folds: DataFrame) -> DataFrame:
    """One row a configuration: growth (the logarithm of 1 + total), total and annualised return, worst drawdown of the chained curve, Sortino, Calmar, return over drawdown, share of winning folds and the deviation of folds.

    Curves are chained by adding logarithms; each fold's first point stands at the
    level where the fold before ended, after no cost of its own.
    """
    begin = folds.select("fold", (F.col("start") + 1).alias("first"))
    rows = days.join(F.broadcast(begin), "fold").withColumn("g", F.when(F.col("t") > F.col("first"), F.col("g")).otherwise(0.0))
    in_order = Window.partitionBy("config_id").orderBy("fold", "t")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum("g").over(so_far))
    # the curve starts at 1: its high is at least 0 in logarithms
    rows = rows.withColumn("depth", F.exp(F.col("level") - F.greatest(F.max("level").over(so_far), F.lit(0.0))) - 1).withColumn("r", F.when(F.col("t") > F.col("first"), F.exp("g") - 1))
    curve = rows.groupBy("config_id").agg(F.sum("g").alias("growth"), F.least(F.min("depth"), F.lit(0.0)).alias("max_dd"), F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("down"))
    per = fold_results(days, folds).groupBy("config_id").agg(F.stddev_pop("ret").alias("consistency"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n_folds"), F.array_sort(F.collect_list(F.struct("fold", "ret"))).alias("fold_returns"))
    length = folds.agg((F.sum(F.col("stop") - F.col("start")) / YEAR).alias("years"))
    out = curve.join(per, "config_id").join(F.broadcast(length), how="cross")  # one row
    out = out.withColumn("total", F.exp("growth") - 1).withColumn("annualised", F.exp(F.col("growth") / F.col("years")) - 1)
    down = F.coalesce(F.col("down") * F.sqrt(F.lit(float(YEAR))), F.lit(1e-4))
    ratio = lambda x: F.when(F.col("max_dd") < 0, x / -F.col("max_dd")).otherwise(0.0)
    out = out.withColumn("down_year", down).withColumn("sortino", F.when(down > 0, F.col("annualised") / down).otherwise(0.0)).withColumn("calmar", ratio(F.col("annualised"))).withColumn("romad", F.least(ratio(F.col("total")), F.lit(1e6)))
    return out.select("config_id", "growth", "years", "total", "annualised", "max_dd", F.col("down_year").alias("downside"), "sortino", "calmar", "romad", "win_rate", "consistency", "n_folds", F.transform("fold_returns", lambda x: x["ret"]).alias("fold_returns"))


#: Fixed values of the forward windows: least breadth, turnover's basis points, yearly yield of cash and debit of margin.
BREADTH, TURNOVER_BPS, CASH_YIELD, MARGIN_DEBIT = 0.30, 5, 0.045, 0.06


def forward_windows(panel: DataFrame, scores: DataFrame, breadth: DataFrame, grid: DataFrame, starts: DataFrame, length: int = 63) -> DataFrame:
    """(config_id, start, ret, ulcer, max_dd, in_cash) of each configuration over each window of `length` days from `start`.

    scores: variant, t, ticker, score; breadth: t, breadth; grid: config_id, variant,
    every, positions, leverage. At each rebalance all goes into equal parts of the
    best positive scores, or into cash where breadth is low or nothing is positive.
    Between rebalances a day's value is a sum over the held tickers and the grown
    cash, whose sign leverage decides, so periods are chained by a running sum of
    logarithms and no configuration is walked day by day.
    """
    last = panel.agg(F.max("t").alias("last"))
    spans = starts.join(F.broadcast(last), how="cross").withColumn("stop", F.least(F.col("start") + length, F.col("last") + 1)).where("stop - start >= 21").select("start", "stop")  # one row
    days = spans.crossJoin(grid.select("every").distinct()).withColumn("rt", F.explode(F.sequence(F.col("start").cast("long"), (F.col("stop") - 1).cast("long"), F.col("every").cast("long"))))
    days = days.withColumn("until", F.least(F.col("rt") + F.col("every"), F.col("stop") - 1)).join(breadth.withColumnRenamed("t", "rt"), "rt")
    order = Window.partitionBy("variant", "rt").orderBy(F.desc("score"), "ticker")
    ranked = scores.where("score > 0").withColumnRenamed("t", "rt").withColumn("rank", F.row_number().over(order)).join(grid.groupBy("variant").agg(F.max("positions").alias("most")), "variant").where(F.col("rank") <= F.col("most"))
    keys = ["config_id", "start", "rt", "until"]
    periods = grid.join(days, "every").select(*keys, "stop", "variant", "positions", "leverage", (F.col("breadth") >= BREADTH).alias("open"))
    picks = periods.where("open").join(ranked, ["variant", "rt"]).where(F.col("rank") <= F.col("positions")).select(*keys, "ticker")
    invested = picks.select(*keys).distinct().withColumn("invested", F.lit(True))
    entry = panel.select("ticker", F.col("t").alias("rt"), F.col("close").alias("paid"))
    held = held_prices(panel, picks, "close").join(entry, ["ticker", "rt"]).groupBy(*keys, "t").agg(F.avg(F.col("close") / F.col("paid")).alias("held"))
    every_day = periods.join(invested, keys, "left").withColumn("invested", F.coalesce("invested", F.lit(False))).withColumn("t", F.explode(F.sequence(F.col("rt"), F.col("until"))))
    marks = every_day.join(held, [*keys, "t"], "left").withColumn("age", F.col("t") - F.col("rt"))
    group = ["config_id", "start"]
    # a day is marked before its cash accrues, a period closed (and the next begun) after
    marks = marks.withColumn("mark", _worth(F.greatest(F.col("age") - 1, F.lit(0)))).withColumn("closing", _worth(F.col("age"))).persist()  # read four times below
    order = Window.partitionBy(*group).orderBy("rt").rowsBetween(Window.unboundedPreceding, -1)
    ends = marks.where("t = until").withColumn("base", F.exp(F.coalesce(F.sum(F.ln("closing")).over(order), F.lit(0.0))) * _growth(CASH_YIELD))
    marks = marks.join(ends.select(*group, "rt", "base"), [*group, "rt"])
    # a rebalance day is marked by the period that it ends
    days_of = marks.where("age > 0 OR t = start").select(*group, (F.col("t") - F.col("start")).alias("day"), F.when(F.col("t") == F.col("start"), 1.0).otherwise(F.col("base") * F.col("mark")).alias("equity"), ((F.col("t") == F.col("start")) | ~F.col("invested")).cast("double").alias("idle"))
    final = marks.where("t = stop - 1 AND t = until").select(*group, (F.col("stop") - F.col("start")).alias("day"), (F.col("base") * F.col("closing")).alias("equity"), F.lit(None).cast("double").alias("idle"))
    w = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = days_of.unionByName(final).withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    return curve.groupBy(*group).agg((F.max_by("equity", "day") - 1).alias("ret"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), F.min("dd").alias("max_dd"), F.avg("idle").alias("in_cash"))


def _growth(yearly: float) -> float:
    return (1 + yearly) ** (1 / YEAR)


def _worth(accruals: Column) -> Column:
    """Value over the value before the rebalance, after so many days' interest on the cash, at the day's prices."""
    lev = F.col("leverage")
    rate = F.when(lev <= 1, _growth(CASH_YIELD)).otherwise(_growth(MARGIN_DEBIT))
    into = (1 - lev * TURNOVER_BPS / 10_000) * (lev * F.coalesce("held", F.lit(1.0)) + (1 - lev) * F.pow(rate, accruals))
    return F.greatest(F.when(F.col("invested"), into).otherwise(F.pow(F.lit(_growth(CASH_YIELD)), accruals)), F.lit(1e-12))


def window_summary(results: DataFrame) -> DataFrame:
    """Percentiles of the windows' returns and depths per configuration."""
    p = results.groupBy("config_id").agg(
        F.count("*").alias("n_windows"),
        F.expr("percentile(ret, array(0.1, 0.25, 0.5, 0.75, 0.9))").alias("p"),
        F.avg("ret").alias("mean_ret"),
        F.expr("percentile(ulcer, 0.5)").alias("p50_ulcer"),
        F.expr("percentile(max_dd, array(0.25, 0.5))").alias("d"),
        F.avg((F.col("ret") > 0).cast("double")).alias("positive"),
    )
    named = [F.col("p")[i].alias(f"p{q}_ret") for i, q in enumerate((10, 25, 50, 75, 90))]
    return p.select("config_id", "n_windows", *named, "mean_ret", "p50_ulcer", F.col("d")[0].alias("p25_max_dd"), F.col("d")[1].alias("p50_max_dd"), "positive")

"""Monte-Carlo paths as rows. Draws come from integer arithmetic on (seed, path, block), so that partitioning and reruns change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annual drift asked for (None: as sampled) and volatility multiplier of each regime.
REGIMES = [("bull", None, 1.0), ("neutral", 0.10, 1.2), ("bear", -0.20, 1.5), ("shock", -0.40, 2.0)]
MODULUS = 2147483647


def draw(seed: int, *parts: Column) -> Column:
    """An integer in [0, MODULUS) by a linear congruence over the parts."""
    x = F.lit(seed % MODULUS).cast("long")
    for p in parts:
        x = (x * 48271 + p.cast("long") * 16807 + 11) % MODULUS
    return (x * 48271) % MODULUS


def block_paths_each(returns: DataFrame, paths: int, horizon: int, block: int, seed: int, last_block: bool = True) -> DataFrame:
    """(ticker, path, step, r): consecutive returns (ticker, i 0-based, r) of every ticker with `block` or more, from drawn starts; the draws of a path are the same for each ticker.

    A block of one day is the plain bootstrap. Without `last_block` no block starts
    at the last possible place, as in the loop form. The history is the small side
    of the join; path rows are made where they are used.
    """
    spark, blocks = returns.sparkSession, -(-horizon // block)
    sizes = returns.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > (block if not last_block else block - 1))
    grid = sizes.crossJoin(spark.range(paths).select(F.col("id").alias("path"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    starts = grid.withColumn("start", draw(seed, F.col("path"), F.col("b")) % (F.col("n") - block + int(last_block)))
    steps = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    steps = steps.select("ticker", "path", (F.col("b") * block + F.col("o")).alias("step"), (F.col("start") + F.col("o")).alias("i")).where(F.col("step") < horizon)
    return steps.join(returns, ["ticker", "i"]).select("ticker", "path", "step", "r")


def block_paths(returns: DataFrame, paths: int, horizon: int, block: int, seed: int) -> DataFrame:
    """(path, step, r) of one history (i, r)."""
    return block_paths_each(returns.select(F.lit("").alias("ticker"), "i", "r"), paths, horizon, block, seed).drop("ticker")


def regimes(spark) -> DataFrame:
    """(regime, target, multiplier): the daily drift asked for, NULL as sampled."""
    rows = [F.struct(F.lit(name).alias("regime"), F.lit(None if d is None else (1 + d) ** (1 / 252) - 1).cast("double").alias("target"), F.lit(k).alias("multiplier")) for name, d, k in REGIMES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def retargeted(paths: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """Under each of `settings` (regime, target, multiplier): a constant is added so that the grand mean of a key's paths meets the target, and deviations from each path's mean are scaled."""
    per = paths.groupBy(*keys, "path").agg(F.avg("r").alias("own"))
    grand = paths.groupBy(*keys).agg(F.avg("r").alias("grand"))
    rows = paths.join(per, [*keys, "path"]).join(grand, keys).crossJoin(F.broadcast(settings))  # a handful of regimes
    shift = F.coalesce(F.col("target") - F.col("grand"), F.lit(0.0))
    return rows.select("regime", *keys, "path", "step", (F.col("own") + (F.col("r") - F.col("own")) * F.col("multiplier") + shift).alias("r"))


def path_totals(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The logarithm of each path's growth: one partial sum a path, no order."""
    return paths.groupBy(*keys, "path").agg(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).alias("growth"))


def baskets(history: DataFrame, weights: DataFrame, paths: int, horizons: list[int], seed: int) -> DataFrame:
    """Per (basket, horizon): percentiles of the final value of 1 from days drawn one by one, the fifth percentile of depth, chances of a loss and of one beyond 20 %.

    history: ticker, date, ret; weights: basket, ticker, w, brought to a sum of one over the tickers there are.
    """
    rows = history.join(weights, "ticker").where("ret IS NOT NULL")
    daily = rows.groupBy("basket", "date").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("r"))
    numbered = daily.select(F.col("basket").alias("ticker"), (F.row_number().over(Window.partitionBy("basket").orderBy("date")) - 1).alias("i"), "r")
    made = block_paths_each(numbered, paths, max(horizons), 1, seed)
    made = made.withColumn("horizon", F.explode(F.lit(horizons))).where(F.col("step") < F.col("horizon"))
    m = path_metrics(made, ["ticker", "horizon"])
    out = m.groupBy(F.col("ticker").alias("basket"), "horizon").agg(
        F.expr("percentile(exp(growth), array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("p"),
        F.expr("percentile(max_dd, 0.05)").alias("worst_dd"),
        F.avg((F.col("total") < -0.20).cast("double")).alias("big_loss"),
        F.avg((F.col("total") < 0).cast("double")).alias("loss"),
    )
    return out.select("basket", "horizon", *[F.col("p")[i].alias(k) for i, k in enumerate(("p5", "p25", "p50", "p75", "p95"))], "worst_dd", "big_loss", "loss")


def entry_points(curve: DataFrame, entries: int, horizon: int, warm: int, seed: int) -> DataFrame:
    """(entry, start): drawn first days, the same for every configuration, such that the horizon fits behind them."""
    last = curve.agg(F.max("t").alias("last"))
    rows = curve.sparkSession.range(entries).select(F.col("id").alias("entry")).join(F.broadcast(last), how="cross")  # one row
    return rows.withColumn("start", F.lit(warm) + draw(seed, F.col("entry")) % F.greatest(F.col("last") - horizon - warm + 1, F.lit(1))).select("entry", "start")


def underwater(curve: DataFrame, entries: DataFrame, horizon: int, depth: float = -0.001) -> DataFrame:
    """Per (config_id, entry): total return over the horizon, worst drawdown, longest run of days below `depth`, days under 90 % and 80 % of the start.

    curve: config_id, t, value. An entry meets its own days by blocks of `horizon` rows.
    """
    block = lambda t: F.floor(t / horizon)
    spans = entries.withColumn("block", F.explode(F.array(block(F.col("start")), block(F.col("start")) + 1)))
    rows = curve.withColumn("block", block(F.col("t"))).join(spans, "block").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + horizon))
    keys = ["config_id", "entry"]
    w = Window.partitionBy(*keys).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("v", F.col("value") / F.first("value").over(so_far)).withColumn("dd", F.col("v") / F.max("v").over(so_far) - 1)
    rows = rows.withColumn("dry", F.max(F.when(F.col("dd") >= depth, F.col("t"))).over(so_far)).withColumn("run", F.when(F.col("dd") < depth, F.col("t") - F.col("dry")).otherwise(0))
    return rows.groupBy(*keys).agg((F.max_by("v", "t") - 1).alias("total"), F.min("dd").alias("max_dd"), F.max("run").alias("streak"), F.sum((F.col("v") < 0.9).cast("long")).alias("below_10"), F.sum((F.col("v") < 0.8).cast("long")).alias("below_20"))


def path_metrics(paths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Growth (the logarithm of one plus the total return), total return, worst drawdown and ulcer of each path; the curve starts at its first return."""
    keys = [*(keys or []), "path"]
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("level", F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(w))
    rows = rows.withColumn("dd", F.exp(F.col("level") - F.max("level").over(w)) - 1)
    return rows.groupBy(*keys).agg(F.max_by("level", "step").alias("growth"), (F.exp(F.max_by("level", "step")) - 1).alias("total"), F.min("dd").alias("max_dd"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"))


def percentiles(frame: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    p = frame.groupBy(*(keys or [])).agg(F.expr(f"percentile({name}, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("p"), F.avg(name).alias("mean"), F.stddev_pop(name).alias("std"))
    return p.select(*(keys or []), *[F.col("p")[i].alias(k) for i, k in enumerate(("p5", "p25", "p50", "p75", "p95"))], "mean", "std")


def crash_injected(paths: DataFrame, buckets: DataFrame, days: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Adds each bucket's crash to the paths it hits: buckets (bucket, frequency a year, magnitude, duration in days). A path and bucket give one span of steps, added by an equi-join on path."""
    who = paths.select("path").distinct().crossJoin(F.broadcast(buckets))  # a handful of buckets
    chance = F.least(F.lit(0.99), F.col("frequency") * (days / 252.0))
    hit = who.where(draw(seed, F.col("path"), F.col("bucket")) / F.lit(float(MODULUS)) < chance)
    spans = hit.withColumn("start", draw(seed + 1, F.col("path"), F.col("bucket")) % F.greatest(F.lit(days) - F.col("duration"), F.lit(1)))
    spans = spans.withColumn("stop", F.least(F.lit(days), F.col("start") + F.col("duration"))).withColumn("drag", F.pow(1 + F.col("magnitude"), 1.0 / (F.col("stop") - F.col("start"))) - 1)
    add = spans.select("path", F.explode(F.sequence("start", F.col("stop") - 1)).alias("step"), "drag").groupBy("path", "step").agg(F.sum("drag").alias("drag"))
    return paths.join(add, ["path", "step"], "left").select(*(keys or []), "path", "step", (F.col("r") + F.coalesce("drag", F.lit(0.0))).alias("r"))

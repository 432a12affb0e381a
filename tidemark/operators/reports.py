"""The scenario report over results (config_id, total, annualised, max_dd, sortino, calmar, win_rate, consistency, fold_returns): one function a section, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the report: caps of drawdown tiers and bounds (above, up to] of drawdown bands, in per cent.
TIERS = [30, 40, 50, 60, 75]
BANDS = [(0, 25), (25, 35), (35, 45), (45, 55), (55, 70), (70, 100)]
PERCENTILES = [5, 10, 25, 50, 75, 90, 95]


def from_folds(folds: DataFrame, years: float = 1.0) -> DataFrame:
    """Results of (config_id, fold, ret), each fold `years` long: the curve has a point a fold."""
    w = Window.partitionBy("config_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    rows = folds.withColumn("level", F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w))
    rows = rows.withColumn("depth", F.exp(F.col("level") - F.greatest(F.max("level").over(w), F.lit(0.0))) - 1)
    out = rows.groupBy("config_id").agg(
        F.max_by("level", "fold").alias("growth"),
        F.count("*").alias("n_folds"),
        F.min("depth").alias("max_dd"),
        F.sqrt(F.avg(F.least("ret", F.lit(0.0)) * F.least("ret", F.lit(0.0)))).alias("down"),
        F.stddev_pop("ret").alias("consistency"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "ret"))), lambda x: x["ret"]).alias("fold_returns"),
    )
    out = out.withColumn("total", F.exp("growth") - 1).withColumn("annualised", F.exp(F.col("growth") / (F.col("n_folds") * years)) - 1)
    return out.withColumn("sortino", F.coalesce(F.try_divide(F.col("annualised"), F.col("down")), F.lit(0.0))).withColumn("calmar", F.coalesce(F.try_divide(F.col("annualised"), F.abs("max_dd")), F.lit(0.0))).drop("growth", "down")


def best_first(rows: DataFrame, by: str = "annualised", n: int = 10, ascending: bool = False) -> DataFrame:
    return rows.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), "config_id").limit(n)


def never_lose(results: DataFrame, wins: float = 0.90) -> DataFrame:
    return results.where((F.col("win_rate") >= wins) & (F.col("annualised") > 0))


def no_blowup(results: DataFrame, worst: float = -0.20) -> DataFrame:
    return results.where(F.coalesce(F.array_min("fold_returns"), F.lit(-1.0)) > worst)


def sleep_well(results: DataFrame, depth: float = 0.30, wins: float = 0.85) -> DataFrame:
    return results.where((F.abs("max_dd") <= depth) & (F.col("win_rate") >= wins))


def survivors(results: DataFrame, depth: float = 0.50) -> DataFrame:
    return results.where(F.abs("max_dd") <= depth)


def tiers(results: DataFrame) -> DataFrame:
    """Per drawdown cap, the tiers overlapping: how many configurations keep it and the best of them."""
    rows = results.withColumn("cap", F.explode(F.lit(TIERS))).where(F.abs("max_dd") * 100 <= F.col("cap"))
    g = rows.groupBy("cap").agg(F.count("*").alias("n"), F.max(F.struct("annualised", (-F.col("config_id")).alias("c"))).alias("b"))
    return g.select("cap", "n", F.col("b.annualised").alias("annualised"), (-F.col("b.c")).alias("config_id"))


def bands(results: DataFrame) -> DataFrame:
    """Per drawdown band the best Calmar ratio."""
    depth = F.abs("max_dd") * 100
    band = F.lit(None).cast("int")
    for low, high in BANDS:
        band = F.when((depth > low) & (depth <= high), low).otherwise(band)
    rows = results.withColumn("band", band).where("band IS NOT NULL")
    g = rows.groupBy("band").agg(F.count("*").alias("n"), F.max(F.struct("calmar", (-F.col("config_id")).alias("c"))).alias("b"))
    return g.select("band", "n", F.col("b.calmar").alias("calmar"), (-F.col("b.c")).alias("config_id"))


def after_worst(results: DataFrame, least: int = 5) -> DataFrame:
    """The worst fold of each configuration with enough of them, and the compounded return of up to three folds behind it (none: no row)."""
    rows = results.where(F.size("fold_returns") >= least).withColumn("at", F.array_position("fold_returns", F.array_min("fold_returns")).cast("int"))
    rows = rows.withColumn("behind", F.slice("fold_returns", F.col("at") + 1, F.lit(3))).where(F.size("behind") > 0)
    return rows.select("config_id", F.array_min("fold_returns").alias("worst"), (F.aggregate("behind", F.lit(1.0), lambda a, r: a * (1 + r)) - 1).alias("next3"))


def fold_percentiles(results: DataFrame) -> DataFrame:
    g = results.select("config_id", F.explode("fold_returns").alias("r")).groupBy("config_id").agg(F.expr("percentile(r, array(0.1, 0.25, 0.5, 0.75, 0.9))").alias("p"), F.min("r").alias("low"), F.max("r").alias("high"))
    return g.select("config_id", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))], "low", "high")


def losing_streak() -> Column:
    """The most losing folds in a row, a fold over the array."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, r: Column) -> Column:
        run = F.when(r < 0, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate("fold_returns", zero, step, lambda s: s["most"])


def distribution(results: DataFrame) -> DataFrame:
    """Percentiles of each measure over all configurations."""
    measures = [("annualised", F.col("annualised")), ("depth", F.abs("max_dd")), ("sortino", F.col("sortino")), ("calmar", F.col("calmar"))]
    long = results.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in measures])).alias("x")).select("x.*")
    g = long.groupBy("metric").agg(F.expr(f"percentile(value, array({', '.join(str(p / 100) for p in PERCENTILES)}))").alias("p"))
    return g.select("metric", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate(PERCENTILES)])


def stormy_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, vol, stormy): the median over tickers of each fold's volatility, and whether it is in the upper quarter of folds."""
    days = panel.join(F.broadcast(folds.select("fold", "start", "stop")), (F.col("t") > F.col("start") + 1) & (F.col("t") <= F.col("stop")))  # some dozens of folds
    per = days.groupBy("fold", "ticker").agg((F.stddev_pop(F.coalesce("ret", F.lit(0.0))) * F.sqrt(F.lit(252.0))).alias("v")).groupBy("fold").agg(F.expr("percentile(v, 0.5)").alias("vol"))
    bar = per.agg(F.expr("percentile(vol, 0.75)").alias("bar"))
    return per.join(F.broadcast(bar), how="cross").select("fold", "vol", (F.col("vol") >= F.col("bar")).alias("stormy"))  # one row


def in_storms(folds: DataFrame, storms: DataFrame) -> DataFrame:
    """Per configuration its mean return in stormy folds."""
    rows = folds.join(storms.where("stormy").select("fold"), "fold", "left_semi")
    return rows.groupBy("config_id").agg(F.avg("ret").alias("storm_return"), F.count("*").alias("n"))


def extremes(results: DataFrame) -> DataFrame:
    """One row: best, median and worst annualised return and drawdown."""
    return results.agg(F.count("*").alias("n"), F.max("annualised").alias("best"), F.expr("percentile(annualised, 0.5)").alias("median"), F.min("annualised").alias("worst"), F.max("max_dd").alias("least_depth"), F.expr("percentile(max_dd, 0.5)").alias("median_depth"), F.min("max_dd").alias("deepest"))


def _values(rows: DataFrame, params: list[str]) -> DataFrame:
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params])).alias("x")).select("x.param", "x.value", "place", "total_rows")


def _placed(results: DataFrame, by: str) -> DataFrame:
    """place: rank by the measure; the table has a row a configuration, ranked in one sorted pass."""
    n = results.agg(F.count("*").alias("total_rows"))
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), "config_id"))).join(F.broadcast(n), how="cross")  # one row


def value_frequency(results: DataFrame, params: list[str], top: int = 50, by: str = "annualised") -> DataFrame:
    """How often each parameter value stands among the best `top`."""
    return _values(_placed(results, by).where(F.col("place") <= top), params).groupBy("param", "value").agg(F.count("*").alias("n"))


def quartile_frequency(results: DataFrame, params: list[str], by: str = "annualised") -> DataFrame:
    """How often each value stands in the best and in the worst quarter of configurations."""
    rows = _values(_placed(results, by), params).withColumn("quarter", F.floor(F.col("total_rows") / 4))
    best, worst = F.col("place") <= F.col("quarter"), F.col("place") > F.col("total_rows") - F.col("quarter")
    return rows.groupBy("param", "value").agg(F.sum(best.cast("long")).alias("best"), F.sum(worst.cast("long")).alias("worst"))


def dead_values(frequency: DataFrame, ratio: float = 5.0) -> DataFrame:
    """Parameter values at least `ratio` times as frequent in the worst quarter as in the best."""
    return frequency.where((F.col("worst") > 0) & (F.col("worst") >= ratio * F.greatest(F.col("best"), F.lit(1)))).select("param", "value")

"""Fund rotation: target funds by rule, holding spells, and money through taxed switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rates of long-term (a year or more) and short-term gains, and the long-term exemption.
LONG_RATE, SHORT_RATE, EXEMPTION = 0.125, 0.20, 125_000.0
CASH = "LIQUID"
FIRST = 12


def with_momentum(monthly: DataFrame) -> DataFrame:
    """Months numbered on one calendar (i, 0-based), with mom (the month before over twelve before) and year (the month over twelve before). monthly: ticker, period, close."""
    w = Window.partitionBy("ticker").orderBy("period")
    calendar = monthly.select("period").distinct().withColumn("i", F.row_number().over(Window.orderBy("period")) - 1)  # a row a month
    rows = monthly.withColumn("mom", F.try_divide(F.lag("close", 1).over(w), F.lag("close", 12).over(w)) - 1).withColumn("year", F.try_divide(F.col("close"), F.lag("close", 12).over(w)) - 1)
    return rows.join(calendar, "period")


def _decided(best: DataFrame, months: list[int], pick: Column) -> DataFrame:
    """(i, period, fund): the pick of the first month that can be decided and of the named months, held till the next."""
    said = F.when(F.month("period").isin(months) | (F.col("i") == FIRST), pick)
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    return best.where(F.col("i") >= FIRST).select("i", "period", F.last(said, ignorenulls=True).over(w).alias("fund"))


def _best(rows: DataFrame) -> DataFrame:
    return rows.where("mom IS NOT NULL").groupBy("i", "period").agg(F.max(F.struct("mom", "ticker")).alias("b"))


def buy_and_hold(rows: DataFrame, fund: str) -> DataFrame:
    return rows.where(F.col("i") >= FIRST).select("i", "period").distinct().withColumn("fund", F.lit(fund))


def best_of(rows: DataFrame, months: list[int], or_cash: bool = False) -> DataFrame:
    """The fund of the best momentum in the named months; cash where even that is negative and `or_cash`."""
    pick = F.col("b.ticker")
    return _decided(_best(rows), months, F.when(F.col("b.mom") < 0, CASH).otherwise(pick) if or_cash else pick)


def best_group(rows: DataFrame, groups: DataFrame, months: list[int]) -> DataFrame:
    """The best fund of the group (ticker, group_id) whose mean momentum is best; cash where that fund's is negative."""
    inside = rows.where("mom IS NOT NULL").join(groups, "ticker").groupBy("i", "period", "group_id").agg(F.avg("mom").alias("mean"), F.max(F.struct("mom", "ticker")).alias("b"))
    best = inside.groupBy("i", "period").agg(F.max(F.struct("mean", "group_id", "b")).alias("g")).select("i", "period", F.col("g.b").alias("b"))
    return _decided(best, months, F.when(F.col("b.mom") < 0, CASH).otherwise(F.col("b.ticker")))


def harvested(rows: DataFrame, sell: int = 3, buy: int = 4) -> DataFrame:
    """Each `buy` month the best fund; in the `sell` month a fund that lost over a year is left for cash. What is held decides, so the months are a fold over one array."""
    months = rows.where(F.col("i") >= FIRST).groupBy("i", "period").agg(F.max(F.when(F.col("mom").isNotNull(), F.struct("mom", "ticker")))["ticker"].alias("best"), F.map_from_entries(F.collect_list(F.struct("ticker", "year"))).alias("years"))
    line = months.agg(F.array_sort(F.collect_list(F.struct("i", "period", "best", "years")), lambda a, b: a["i"] - b["i"]).alias("months"))
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("path"))

    def step(s: Column, m: Column) -> Column:
        lost = F.coalesce(F.try_element_at(m["years"], F.coalesce(s["held"], F.lit(""))) < 0, F.lit(False))
        now = F.when(s["held"].isNull() | (F.month(m["period"]) == buy), m["best"]).when((F.month(m["period"]) == sell) & lost, F.lit(CASH)).otherwise(s["held"])
        return F.struct(now.alias("held"), F.concat(s["path"], F.array(now)).alias("path"))

    path = line.select("months", F.aggregate("months", start, step, lambda s: s["path"]).alias("path"))
    return path.select(F.explode(F.arrays_zip("months", "path")).alias("x")).select("x.months.i", "x.months.period", F.col("x.path").alias("fund"))


def spells(targets: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spell, fund, entry, exit, months, open): holding spells of targets (keys, i, period, fund), sold at the month that the next begins. prices: i, fund, close."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = targets.withColumn("spell", F.sum((F.col("fund") != F.coalesce(F.lag("fund").over(w), F.lit(""))).cast("int")).over(w))
    ends = rows.groupBy(*keys, "spell").agg(F.min("i").alias("since"), F.max("i").alias("last"), F.first("fund").alias("fund"))
    ends = ends.withColumn("next", F.lead("since").over(Window.partitionBy(*keys).orderBy("spell"))).withColumn("until", F.coalesce("next", "last"))
    entry = prices.select(F.col("fund"), F.col("i").alias("since"), F.col("close").alias("entry"))
    leave = prices.select(F.col("fund"), F.col("i").alias("until"), F.col("close").alias("exit"))
    return ends.join(entry, ["fund", "since"]).join(leave, ["fund", "until"]).select(*keys, "spell", "fund", "entry", "exit", (F.col("until") - F.col("since")).alias("months"), F.col("next").isNull().alias("open"))


def tax(gain: Column, months: Column) -> Column:
    """Long-term rate above the exemption from a year on, the short-term rate before; losses owe nothing."""
    return F.when(gain <= 0, 0.0).when(months >= 12, LONG_RATE * F.greatest(gain - EXEMPTION, F.lit(0.0))).otherwise(SHORT_RATE * gain)


def taxed(spells: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """(keys, value, tax, switches): the exemption makes a sale's tax depend on the money so far, so the spells are a fold over one array a strategy."""
    packed = spells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("spell", "entry", "exit", "months", "open"))).alias("s"))
    start = F.struct(F.lit(float(capital)).alias("money"), F.lit(0.0).alias("tax"), F.lit(0).alias("switches"))

    def step(a: Column, x: Column) -> Column:
        proceeds = a["money"] * x["exit"] / x["entry"]
        owed = F.when(x["open"], 0.0).otherwise(tax(proceeds - a["money"], x["months"]))
        return F.struct((proceeds - owed).alias("money"), (a["tax"] + owed).alias("tax"), (a["switches"] + F.when(x["open"], 0).otherwise(1)).alias("switches"))

    out = packed.select(*keys, F.aggregate("s", start, step).alias("a"))
    return out.select(*keys, F.col("a.money").alias("value"), F.col("a.tax").alias("tax"), F.col("a.switches").alias("switches"))

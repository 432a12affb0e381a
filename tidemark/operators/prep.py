"""Preparing panels: total return, alignment, corporate actions, quality gates, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.sources.panel import by_ticker

#: Fixed split factors that an inferred one is snapped to.
FACTORS = [1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 100.0]


def so_far() -> WindowSpec:
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def dividend_yield() -> Column:
    """Dividend over the previous close; 0 on the first day."""
    return F.coalesce(F.try_divide(F.col("dividend"), F.lag("close").over(by_ticker())), F.lit(0.0))


def with_total_return(panel: DataFrame) -> DataFrame:
    """tri: close x product of (1 + yield); tri_sum: close x (1 + sum of yields)."""
    rows = panel.withColumn("y", dividend_yield())
    return rows.withColumn("tri", F.col("close") * F.exp(F.sum(F.log1p("y")).over(so_far()))).withColumn("tri_sum", F.col("close") * (1 + F.sum("y").over(so_far()))).drop("y")


def scaffold(panel: DataFrame) -> DataFrame:
    """Every ticker on every date of the union calendar; missing rows are NULL. Both sides are distinct keys of the panel, small beside it."""
    dates = panel.select("date").distinct()
    grid = dates.crossJoin(panel.select("ticker").distinct())  # calendar x universe: the aligned panel itself
    return grid.join(panel.drop("t"), ["ticker", "date"], "left").withColumn("t", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def forward_fill(name: str) -> Column:
    return F.last(name, ignorenulls=True).over(so_far())


def fill_both(name: str) -> Column:
    return F.coalesce(forward_fill(name), F.first(name, ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing)))


def split_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Close over the product of factors whose ex-date is after the bar.

    A union timeline and a reverse cumulative product, in place of a join of
    bars with all later actions.
    """
    events = actions.select("ticker", F.col("ex_date").alias("date"), F.lit(None).cast("double").alias("close"), F.ln("factor").alias("lf"), F.lit(0).alias("kind"))
    rows = bars.select("ticker", "date", "close", F.lit(0.0).alias("lf"), F.lit(1).alias("kind")).unionByName(events)
    # on one date the event (kind 0) stands before the bar, so it doesn't count as later
    later = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("after", F.sum("lf").over(later))
    return rows.where("kind = 1").select("ticker", "date", "close", (F.col("close") / F.exp("after")).alias("adj_close"))


def snap_factor(raw: Column) -> Column:
    """The nearest of FACTORS if within 20%, else the value itself."""
    options = F.transform(F.lit(FACTORS), lambda f: F.struct(F.abs(f - raw).alias("gap"), f.alias("factor")))
    best = F.array_min(options)
    return F.when(best["gap"] <= 0.2 * best["factor"], best["factor"]).otherwise(raw)


#: A close over the next outside this band is taken for a corporate action; gaps of more days than GAP for missing data.
BAND, GAP, NEAR = (0.7, 1.4), 7, 3


def _outside(ratio: Column) -> Column:
    return (ratio <= BAND[0]) | (ratio >= BAND[1])


def changed_identity(bars: DataFrame) -> DataFrame:
    """(ticker, ex_date, factor) where a ticker's identifier `isin` changes from one bar to the next and the closes are too far apart."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars.withColumn("before", F.lag("isin").over(w)).withColumn("ratio", F.try_divide(F.lag("close").over(w), F.col("close")))
    known = (F.coalesce("before", F.lit("")) != "") & (F.coalesce("isin", F.lit("")) != "")
    return rows.where(known & (F.col("before") != F.col("isin")) & _outside(F.col("ratio"))).select("ticker", F.col("date").alias("ex_date"), snap_factor(F.col("ratio")).alias("factor"))


def not_near(inferred: DataFrame, known: DataFrame, days: int = NEAR) -> DataFrame:
    """Inferred actions but those within some days of a known one, or of an inferred one before them that stands.

    The first rule is an anti-join on ticker and nearby dates; the second depends on
    which earlier ones stand, so it is a fold over each ticker's dates in order.
    """
    apart = inferred.join(known.select(F.col("ticker").alias("k"), F.col("ex_date").alias("d")), (F.col("ticker") == F.col("k")) & (F.abs(F.datediff("ex_date", "d")) <= days), "left_anti")
    packed = apart.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("ex_date", "factor"))).alias("events"))
    none = F.filter("events", lambda e: F.lit(False))

    def standing(kept: Column, e: Column) -> Column:
        free = kept.isNull() | (F.size(kept) == 0) | (F.datediff(e["ex_date"], F.element_at(F.transform(kept, lambda k: k["ex_date"]), -1)) > days)
        return F.when(free, F.concat(kept, F.array(e))).otherwise(kept)

    return packed.select("ticker", F.explode(F.aggregate("events", none, standing)).alias("e")).select("ticker", "e.ex_date", "e.factor")


def residual_factors(adjusted: DataFrame) -> DataFrame:
    """(ticker, ex_date, factor) of what is left in adjusted closes (ticker, date, adj_close): a jump between near bars, but for factors within 5 % of one."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = adjusted.withColumn("ratio", F.try_divide(F.lag("adj_close").over(w), F.col("adj_close"))).withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    rows = rows.where((F.col("ratio") > 0) & (F.col("gap") <= GAP) & _outside(F.col("ratio"))).withColumn("factor", snap_factor(F.col("ratio")))
    return rows.where(F.abs(F.col("factor") - 1) >= 0.05).select("ticker", F.col("date").alias("ex_date"), "factor")


def fully_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars (ticker, date, close, isin) adjusted by known actions, by those inferred from identifiers, and once more by what is left."""
    known = actions.select("ticker", "ex_date", "factor")
    factors = known.unionByName(not_near(changed_identity(bars), known))
    return split_adjusted(bars, factors.unionByName(residual_factors(split_adjusted(bars, factors))))


def populated(panel: DataFrame, first: int, last: int, share: float = 0.9) -> DataFrame:
    """The window's rows of tickers that have a value on at least `share` of its days."""
    window = panel.where((F.col("t") >= first) & (F.col("t") <= last))
    enough = window.groupBy("ticker").agg(F.count("close").alias("n")).where(F.col("n") >= share * (last - first + 1)).select("ticker")
    return window.join(enough, "ticker", "left_semi")


def folded(frames: list[DataFrame], key: str) -> DataFrame:
    """Frames of one value column each, side by side on their key: stacked long and grouped once, not a chain of outer joins."""
    names = [next(c for c in f.columns if c != key) for f in frames]
    rows = None
    for frame, name in zip(frames, names, strict=True):
        long = frame.select(F.col(key), F.lit(name).alias("name"), F.col(name).cast("double").alias("value"))
        rows = long if rows is None else rows.unionByName(long)
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


#: Fixed values of the master filter.
EXCLUDED = ["idcw", "dividend", "regular plan", "bonus", "payout", "institutional", "segregated", "annual", "monthly", "quarterly", "weekly", "reinvestment"]
DROPPED = [" - Direct Plan", " Direct Plan", "-Direct Plan", " - Growth Option", " - Growth", "-Growth", " Growth", " Option", " Fund"]
NAME_CHARS = 45


def master_filter(schemes: DataFrame) -> DataFrame:
    """Direct growth schemes (scheme_code, scheme_name) without the excluded kinds, with a short name."""
    low = F.lower("scheme_name")
    rows = schemes.where(low.contains("direct") & (low.contains("growth") | low.endswith(" gr")) & ~low.rlike("|".join(EXCLUDED)))
    short = F.col("scheme_name")
    for words in DROPPED:
        short = F.replace(short, F.lit(words), F.lit(""))
    return rows.select("scheme_code", "scheme_name", F.substring(short, 1, NAME_CHARS).alias("name"))


def safe_havens(names: DataFrame, tickers: list[str], keywords: list[str]) -> DataFrame:
    """Tickers (ticker, name) that are listed, or whose name has a keyword."""
    return names.where(F.col("ticker").isin(tickers) | F.lower("name").rlike("|".join(keywords))).select("ticker").distinct()


def jump_ratios(panel: DataFrame, low: float = -2 / 3, high: float = 2.0) -> DataFrame:
    """Closes rescaled so that jumps beyond the band vanish, anchored at the latest price: one reverse product."""
    r = F.try_divide(F.col("close"), F.lag("close").over(by_ticker()))
    jump = F.when((r - 1 > high) | (r - 1 < low), F.ln(r)).otherwise(F.lit(0.0))
    ahead = Window.partitionBy("ticker").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    rows = panel.withColumn("jump", jump)
    return rows.withColumn("repaired", F.col("close") * F.exp(F.coalesce(F.sum("jump").over(ahead), F.lit(0.0)))).drop("jump")


def coverage(panel: DataFrame) -> DataFrame:
    """Per ticker: rows, first and last date, longest gap in days, largest absolute move."""
    rows = panel.withColumn("gap", F.datediff("date", F.lag("date").over(by_ticker()))).withColumn("move", F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1))
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("gap").alias("max_gap"), F.max("move").alias("max_move"))


def quality_gate(panel: DataFrame, min_days: int = 252, move: float = 0.2, max_moves: int = 3, top: int = 100) -> DataFrame:
    """Tickers with enough days and few large moves, best covered first."""
    rows = panel.withColumn("move", F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1))
    per = rows.groupBy("ticker").agg(F.count("close").alias("days"), F.sum((F.col("move") > move).cast("long")).alias("moves"))
    return per.where((F.col("days") >= min_days) & (F.col("moves") <= max_moves)).orderBy(F.desc("days"), "ticker").limit(top)


def resample(panel: DataFrame, unit: str = "month") -> DataFrame:
    """Last close of each calendar unit; weeks are named by their Monday."""
    return panel.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(F.max_by("close", "date").alias("close"))


def common_periods(monthly: DataFrame) -> DataFrame:
    """Rows of the periods that every ticker has."""
    everyone = monthly.agg(F.count_distinct("ticker").alias("n"))
    full = monthly.groupBy("period").agg(F.count_distinct("ticker").alias("k")).join(F.broadcast(everyone), F.col("k") == F.col("n")).select("period")  # one row
    return monthly.join(full, "period", "left_semi")


def stitched(segments: DataFrame) -> DataFrame:
    """(key, date, nav, priority): on one date the segment of the highest priority wins."""
    w = Window.partitionBy("key", "date").orderBy(F.desc("priority"))
    return segments.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Left rows with the right side's latest value at or before `at`: a union timeline and one window, no range join."""
    rows = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__o", F.lit(1))
    facts = right.select(key, at, F.col(value).alias("__v"), F.lit(0).alias("__o"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__o = 1").drop("__v", "__o")

"""Quality, volume and level signals over a panel that has ret and lret."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.momentum import back, frame
from tidemark.sources.panel import by_ticker

YEAR = 252
ROOT_YEAR = YEAR**0.5


def trend_r2(n: int = 252, skip: int = 0) -> Column:
    """R2 of log price on the row number; 0 for a constant series."""
    w = frame(-(n - 1) - skip, -skip)
    lnp, t = F.ln("close"), F.col("t").cast("double")
    return F.when(F.regr_syy(lnp, t).over(w) > 0, F.regr_r2(lnp, t).over(w)).otherwise(0.0)


def share_up(n: int = 252, skip: int = 0) -> Column:
    return F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).over(frame(-(n - 1) - skip, -skip))


def smoothness(n: int = 252, skip: int = 0) -> Column:
    return F.sqrt(trend_r2(n, skip) * share_up(n, skip))


def downside(kind: str) -> Column:
    """Downside volatility by name: the window, whether zeros stand in for gains, and the degrees of freedom differ."""
    neg = F.when(F.col("ret") < 0, F.col("ret"))
    clipped = F.least("ret", F.lit(0.0))
    year, history, forty = frame(-251, 0), by_ticker().rowsBetween(Window.unboundedPreceding, 0), frame(-39, 0)
    floor = F.lit(1e-4)
    root = F.lit(ROOT_YEAR)
    table = {
        "dnv_hist_neg": lambda: F.coalesce(F.stddev_pop(neg).over(history) * root, floor),
        "dnv_252_neg": lambda: F.greatest(F.coalesce(F.stddev_pop(neg).over(year) * root, floor), floor),
        "dnv_40_neg": lambda: F.coalesce(F.stddev_pop(neg).over(forty) * root, floor),
        "dnv_252_clip0": lambda: F.stddev_pop(clipped).over(year) * root,
        "dnv_252_rms0": lambda: F.sqrt(F.avg(clipped * clipped).over(year)) * root,
        "dnv_panel_neg": lambda: F.stddev_pop(neg).over(frame(-272, -21)) * root,
        "dnv_window_neg": lambda: F.stddev_pop(neg).over(frame(-272, 0)) * root,
        "dnv_rms_neg": lambda: F.sqrt(F.avg(neg * neg).over(year)) * root,
        "dnv_neg_ddof1": lambda: F.stddev_samp(neg).over(year) * root,
        "dnv_monthly_sq": lambda: F.sqrt(F.avg(clipped * clipped).over(frame(-11, 0))),
    }
    return table[kind]()


DOWNSIDE = ["dnv_hist_neg", "dnv_252_neg", "dnv_40_neg", "dnv_252_clip0", "dnv_252_rms0", "dnv_panel_neg", "dnv_window_neg", "dnv_rms_neg", "dnv_neg_ddof1", "dnv_monthly_sq"]


def total_vol(n: int = 126) -> Column:
    return F.greatest(F.coalesce(F.stddev_pop("ret").over(frame(-(n - 1), 0)) * ROOT_YEAR, F.lit(1e-4)), F.lit(1e-4))


def trend_t(n: int = 252) -> tuple[Column, Column]:
    """Slope of log price per row, and its t statistic."""
    w = frame(-(n - 1), 0)
    lnp, t = F.ln("close"), F.col("t").cast("double")
    slope, count = F.regr_slope(lnp, t).over(w), F.regr_count(lnp, t).over(w)
    sxx, syy, sxy = F.regr_sxx(lnp, t).over(w), F.regr_syy(lnp, t).over(w), F.regr_sxy(lnp, t).over(w)
    error = F.sqrt(F.try_divide(F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0)), count - 2)) / F.sqrt(sxx)
    return slope, F.when((count > 2) & (error > 0), F.try_divide(slope, error))


def consistent(months: int = 11, least: int = 8, skip: int = 21) -> Column:
    """At least `least` of the returns over 21 rows are positive, in the months two to twelve back: the first ends 21 rows before the skipped month's start. True where history is short."""
    ups = F.lit(0)
    for m in range(1, months + 1):
        ups = ups + F.when(back("close", skip - 1 + 21 * m) > back("close", skip - 1 + 21 * (m + 1)), 1).otherwise(0)
    return F.when(back("close", skip - 1 + 21 * (months + 1)).isNotNull(), ups >= least).otherwise(F.lit(True))


def below_high(n: int = 252) -> Column:
    return 1 - F.try_divide(F.col("close"), F.max("close").over(frame(-(n - 1), 0)))


def level_factor(distance: Column) -> Column:
    """1.10 within 10% of the high, 1.00 within 25%, then falling by half the excess to 0.85; 1.0 when unknown."""
    return F.when(distance.isNull(), 1.0).when(distance < 0.10, 1.10).when(distance < 0.25, 1.0).otherwise(F.greatest(F.lit(0.85), 1.0 - 0.5 * (distance - 0.25)))


def volume_slope(n: int = 63) -> Column:
    return F.regr_slope(F.ln(F.greatest("dvol", F.lit(1e-4))), F.col("t").cast("double")).over(frame(-(n - 1), 0)) * YEAR


def volume_factor(slope: Column) -> Column:
    """Between 0.7 and 1.3, NULL without a slope."""
    return F.when(slope.isNotNull(), F.least(F.greatest(1 + 0.15 * slope, F.lit(0.7)), F.lit(1.3)))


def ma_cross(fast: int = 50, slow: int = 200) -> Column:
    """Whether the fast mean is above the slow one; NULL until the slow window is full."""
    w = frame(-(slow - 1), 0)
    return F.when(F.count("close").over(w) == slow, F.avg("close").over(frame(-(fast - 1), 0)) > F.avg("close").over(w))


def below_own_mean(n: int = 100) -> Column:
    """Yesterday's close below the mean of the n rows up to it."""
    return back("close", 1) < F.avg("close").over(frame(-n, -1))


def vol_state(n: int = 60, low: float = 0.14, high: float = 0.22) -> Column:
    v = F.stddev_pop("ret").over(frame(-(n - 1), 0)) * ROOT_YEAR
    return F.when(v < low, "low").when(v < high, "mid").when(v.isNotNull(), "high")


def zscore(name: str, n: int = 252, least: int = 5) -> Column:
    """Rolling z-score with its own row in the window; 0 where the window has under `least` values or no spread."""
    w = frame(-(n - 1), 0)
    z = F.try_divide(F.col(name) - F.avg(name).over(w), F.stddev_pop(name).over(w))
    return F.coalesce(F.when(F.count(name).over(w) >= least, z), F.lit(0.0))


def full_sum(name: str, n: int) -> Column:
    w = frame(-(n - 1), 0)
    return F.when(F.count(name).over(w) == n, F.sum(name).over(w))


def safe_corr(a: str, b: str, w) -> Column:
    """Pearson correlation, NULL where either side is constant."""
    return F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))


def market_level(panel: DataFrame, clip: float = 0.2) -> DataFrame:
    """Per date the equal-weight mean of clipped returns: a small table, then one ordered product over dates."""
    daily = panel.groupBy("date").agg(F.avg(F.greatest(F.least("ret", F.lit(clip)), F.lit(-clip))).alias("r"))
    return daily.withColumn("level", F.exp(F.sum(F.ln(1 + F.coalesce("r", F.lit(0.0)))).over(Window.orderBy("date"))))


def keyword_count(text: Column, words: list[str]) -> Column:
    """Occurrences of any of the words as substrings."""
    low = F.lower(text)
    return sum(((F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))


def polarity(text: Column, positive: list[str], negative: list[str]) -> Column:
    p, n = keyword_count(text, positive), keyword_count(text, negative)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def presence_polarity(text: Column, positive: list[str], negative: list[str], squash: float = 0.7) -> Column:
    """How many of the words are there at all, good less bad over both, times `squash`; 0 where none is."""
    low = F.lower(text)
    p, n = (sum((low.contains(w).cast("int") for w in words), F.lit(0)) for words in (positive, negative))
    return F.greatest(F.least(F.coalesce(F.try_divide((p - n).cast("double"), p + n) * squash, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))


def null_ratios(frame: DataFrame, features: list[str]) -> DataFrame:
    """(feature, ratio): the share of rows where it is NULL or NaN."""
    row = frame.agg(*[F.avg((F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("double")).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("ratio")) for f in features])).alias("x")).select("x.*")


def correlated_features(frame: DataFrame, features: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) of every pair of features a before b, from one pass over the rows; only pairs with |r| above `least`."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = lambda a, b: F.when(both(a, b), F.col(a).cast("double"))
    row = frame.agg(*[F.try_divide(F.covar_pop(one(a, b), one(b, a)), F.stddev_pop(one(a, b)) * F.stddev_pop(one(b, a))).alias(f"{a}|{b}") for a, b in pairs])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")
    return out.where(F.abs("r") > least)


def daily_from_quarters(quarters: DataFrame, last: Column) -> DataFrame:
    """(date, score, n) of every day from the first quarter end to `last`, each with the latest quarter (q, score, n) that has ended; business days are those of weekday < 5."""
    w = Window.orderBy("q")  # a row a quarter
    spans = quarters.withColumn("until", F.coalesce(F.date_sub(F.lead("q").over(w), 1), last)).where(F.col("until") >= F.col("q"))
    return spans.select(F.explode(F.sequence("q", "until")).alias("date"), "score", "n").withColumn("business", F.weekday("date") < 5)

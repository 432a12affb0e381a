"""Return and momentum columns over a panel (ticker, t, close). NULL means missing; conventions that differ have names of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.panel import by_ticker


def back(name: str, k: int) -> Column:
    return F.lag(name, k).over(by_ticker())


def frame(lo: int, hi: int):
    """Rows t+lo .. t+hi of the ticker."""
    return by_ticker().rowsBetween(lo, hi)


def simple_return(name: str = "close") -> Column:
    return F.try_divide(F.col(name), back(name, 1)) - 1


def log_return(name: str = "close") -> Column:
    return F.ln(F.try_divide(F.col(name), back(name, 1)))


def skip_short(lb: int, skip: int = 21) -> Column:
    """p[t-skip] / p[t-skip-lb+1] - 1, 0 where history is short."""
    return F.coalesce(F.try_divide(back("close", skip), back("close", skip + lb - 1)) - 1, F.lit(0.0))


def skip_full(lb: int, skip: int = 21) -> Column:
    """p[t-skip] / p[t-skip-lb] - 1, NULL where history is short."""
    return F.try_divide(back("close", skip), back("close", skip + lb)) - 1


def no_skip(lb: int) -> Column:
    return F.try_divide(F.col("close"), back("close", lb)) - 1


def previous_bar(lb: int, skip: int = 21) -> Column:
    """Rows before t only: p[t-1-skip] / p[t-skip-lb] - 1."""
    return F.try_divide(back("close", 1 + skip), back("close", skip + lb)) - 1


def blend(lookbacks=(63, 126, 252), weights=(0.2, 0.4, 0.4), skip: int = 21) -> Column:
    total = F.lit(0.0)
    for lb, w in zip(lookbacks, weights, strict=True):
        total = total + F.lit(w) * skip_short(lb, skip)
    return total


def available_blend(lookbacks=(63, 126, 252), weights=(0.2, 0.4, 0.4), skip: int = 21) -> Column:
    """Weights spread over the lookbacks that have history."""
    up, down = F.lit(0.0), F.lit(0.0)
    for lb, w in zip(lookbacks, weights, strict=True):
        m = previous_bar(lb, skip)
        up = up + F.when(m.isNotNull(), F.lit(w) * m).otherwise(0.0)
        down = down + F.when(m.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.try_divide(up, down)


def sign_composite(lookbacks=(63, 126, 252), skip: int = 21) -> Column:
    signs = sum((F.signum(skip_short(lb, skip)) for lb in lookbacks), F.lit(0.0))
    return F.abs(signs) / len(lookbacks) * blend(lookbacks, skip=skip)


def log_momentum(lb: int, skip: int = 21) -> Column:
    return F.ln(F.try_divide(back("close", skip), back("close", skip + lb - 1)))


def ewma_log_momentum(lb: int = 126, skip: int = 21, half_life: float = 63.0) -> Column:
    """Exponentially weighted mean of log returns in the skipped window; a factor common to its weights cancels, so a row's weight may follow from its own number (up to some 40000 rows of a ticker)."""
    span = frame(-(skip + lb - 2), -skip)
    weight = F.when(F.col("lret").isNotNull(), F.exp(F.lit(0.6931471805599453 / half_life) * F.col("t")))
    return F.try_divide(F.sum(F.col("lret") * weight).over(span), F.sum(weight).over(span))


def volnorm_log_momentum(lb: int = 126, skip: int = 21) -> Column:
    return F.try_divide(log_momentum(lb, skip), F.stddev_pop("lret").over(frame(-(skip + lb - 2), -skip)) * F.sqrt(F.lit(float(lb))))


def acceleration(lb: int = 126, skip: int = 21) -> Column:
    """Base log momentum plus half of (second half - first half); the halves meet lb // 2 rows after the start."""
    end, mid, start = back("close", skip), back("close", skip + lb - 1 - lb // 2), back("close", skip + lb - 1)
    return F.ln(F.try_divide(end, start)) + 0.5 * (F.ln(F.try_divide(end, mid)) - F.ln(F.try_divide(mid, start)))


def trimmed_log_momentum(lb: int = 126, skip: int = 21, share: float = 0.05) -> Column:
    """Sum of the window's log returns without the least and the largest share of them (one at least). A window's array has lb entries."""
    rets = F.sort_array(F.collect_list("lret").over(frame(-(skip + lb - 2), -skip)))
    n = F.size(rets)
    k = F.greatest(F.floor(n * F.lit(share)).cast("int"), F.lit(1))
    return F.when(n > 2 * k, F.aggregate(F.slice(rets, k + 1, F.greatest(n - 2 * k, F.lit(0))), F.lit(0.0), lambda a, x: a + x))


def weeks(tilt: bool = False) -> Column:
    w = (0.4, 0.3, 0.2, 0.1) if tilt else (0.25,) * 4
    return sum((F.lit(a) * no_skip(lb) for a, lb in zip(w, (5, 10, 20, 40), strict=True)), F.lit(0.0))


def breadth(panel: DataFrame, lb: int = 20) -> DataFrame:
    """Per date the share of tickers with a positive return over lb rows."""
    m = panel.withColumn("m", no_skip(lb))
    up = F.sum(F.when(F.col("m") > 0, 1).otherwise(0))
    return m.groupBy("date").agg((up / F.greatest(F.count("m"), F.lit(1))).alias("breadth"))


def rolling_cagr(years: int, per_year: int = 252) -> Column:
    return F.pow(F.try_divide(F.col("close"), back("close", per_year * years)), F.lit(1.0 / years)) - 1


def yoy_growth(eps: DataFrame) -> DataFrame:
    """(ticker, report_date, eps) -> year-over-year change over four reports; a base near zero gives the sign of the change."""
    w = Window.partitionBy("ticker").orderBy("report_date")
    prior = F.lag("eps", 4).over(w)
    growth = F.when(F.abs(prior) > 0.01, (F.col("eps") - prior) / F.abs(prior)).otherwise(F.signum(F.col("eps") - prior))
    return eps.withColumn("yoy", F.when(prior.isNotNull(), growth))

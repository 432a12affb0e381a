"""Scalar formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def daily_rate(annual: Column) -> Column:
    return F.pow(1 + annual, F.lit(1 / 252.0)) - 1


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, off by less than 7.5e-8."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 1 - F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, upper).otherwise(1 - upper)


def black_scholes(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, kind: str = "put") -> Column:
    """European price; intrinsic value where time or volatility is not positive."""
    spread = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / spread
    d2 = d1 - spread
    discounted = strike * F.exp(-rate * years)
    if kind == "put":
        price, intrinsic = discounted * normal_cdf(-d2) - spot * normal_cdf(-d1), F.greatest(strike - spot, F.lit(0.0))
    else:
        price, intrinsic = spot * normal_cdf(d1) - discounted * normal_cdf(d2), F.greatest(spot - strike, F.lit(0.0))
    return F.when((years <= 0) | (vol <= 0), intrinsic).otherwise(price)


def delta(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, kind: str = "put") -> Column:
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * F.sqrt(years))
    return normal_cdf(d1) - (1 if kind == "put" else 0)


def contracts(amount: Column, price: Column) -> Column:
    """Whole contracts of 100, one at least."""
    return F.greatest(F.lit(1), F.floor(amount / (price * 100)))


def quarter_end(date: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def cents(x: Column) -> Column:
    """To two decimals, halves up in plain double arithmetic."""
    return F.floor(x * 100 + 0.5) / 100.0


def option_record(kind: str, price: Column, vol: Column, away: float, days: int = 90, rate: float = 0.05) -> Column:
    """A struct: strike some share away from the price, premium, its share of the price, delta, break-even, and what a put protects or a call levers."""
    years = F.lit(days / 365.0)
    strike = cents(price * (1 - away if kind == "put" else 1 + away))
    premium = black_scholes(price, strike, years, F.lit(rate), vol, kind)
    own = (price - strike - cents(premium)) if kind == "put" else F.when(premium > 0, price / premium).otherwise(0.0)
    even = (price if kind == "put" else strike) + premium
    return F.struct(strike.alias("strike"), cents(premium).alias("premium"), (premium / price).alias("cost"), F.round(delta(price, strike, years, F.lit(rate), vol, kind), 3).alias("delta"), cents(even).alias("breakeven"), cents(own).alias("protected" if kind == "put" else "leverage"))


def affordable(wanted: Column, premium: Column, budget: Column) -> Column:
    """Contracts of 100 that a budget pays for, of those wanted; none below one."""
    return F.least(wanted, F.greatest(F.coalesce(F.floor(F.try_divide(budget, premium * 100)), F.lit(0)), F.lit(0)))


def log_metrics(text: Column) -> Column:
    """What a run's printed log says, by patterns; 0 where it doesn't."""
    clean = F.regexp_replace(text, "\\x1b\\[[0-9;]*m", "")
    number = lambda pattern, k=1: F.coalesce(F.regexp_extract(clean, pattern, k).try_cast("double"), F.lit(0.0))
    return F.struct(
        number(r"Survivable.*?:\s*(\d+)/(\d+)").cast("long").alias("n_survivable"),
        number(r"Survivable.*?:\s*(\d+)/(\d+)", 2).cast("long").alias("n_combos"),
        number(r"folds=(\d+)").cast("long").alias("n_folds"),
        number(r"median:\s*([+\-]?\d+\.?\d*)%").alias("median"),
        number(r"best:\s*([+\-]?\d+\.?\d*)%").alias("best"),
    )


def flattened(prefix: str, struct: str, fields: list[str], arrays: tuple[str, ...] = ()) -> list[Column]:
    """Columns prefix_field of a struct's fields, arrays joined by commas."""
    return [(F.array_join(F.col(f"{struct}.{f}").cast("array<string>"), ",") if f in arrays else F.col(f"{struct}.{f}")).alias(f"{prefix}_{f}") for f in fields]

"""Strategies over time: switches as windows, periods as aggregates, and engines with state of their own as one grouped function a configuration."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prep import so_far
from tidemark.sources.panel import by_ticker


def switch(change: Column, to_cash: float, to_momentum: float, initial: str = "MOMENTUM") -> Column:
    """Hysteresis: CASH below one bound, MOMENTUM above the other, else as before; the first row and a NULL change say `initial`."""
    said = F.when(change < to_cash, "CASH").when(change > to_momentum, "MOMENTUM")
    return F.when(change.isNull(), initial).otherwise(F.coalesce(F.last(said, ignorenulls=True).over(so_far()), F.lit(initial)))


def equity_under(signal: str = "signal", price: str = "close", start: float = 1000.0) -> Column:
    """Equity that takes a row's return if the row before said MOMENTUM."""
    step = F.when(F.lag(signal).over(by_ticker()) == "MOMENTUM", F.try_divide(F.col(price), F.lag(price).over(by_ticker()))).otherwise(1.0)
    return F.lit(start) * F.exp(F.sum(F.ln(F.coalesce(step, F.lit(1.0)))).over(so_far()))


def expanding_folds(panel: DataFrame, train: int, length: int, least: int = 15) -> DataFrame:
    """(fold, start, stop, live): out-of-sample windows from `train` rows of the calendar on, each as long as `length` or to the calendar's last row, the next starting where one stops; short ones (21 rows) end the list, ones with under `least` tickers alive before them are left out.

    panel: ticker, t (0-based calendar numbers are t - 1, as in `start` and `stop`).
    """
    whole = panel.groupBy("ticker").agg(F.min("t").alias("born"), F.max("t").alias("last"))  # a row per ticker
    last = whole.agg((F.max("last") - 1).alias("last"))
    steps = F.sequence(F.lit(train).cast("long"), F.greatest(F.col("last") - 21, F.lit(train)).cast("long"), F.lit(length).cast("long"))
    starts = last.select(F.explode(steps).alias("start"), "last").select("start", F.least(F.col("start") + length, F.col("last")).alias("stop")).where("stop - start >= 21")
    live = starts.join(whole, F.col("born") <= F.col("start")).groupBy("start", "stop").agg(F.count("*").alias("live")).where(F.col("live") >= least)
    return live.withColumn("fold", F.row_number().over(Window.orderBy("start"))).select("fold", "start", "stop", "live")  # some dozens of rows


#: Rows of a ticker that a range join takes as one block.
BLOCK = 64


def held_prices(panel: DataFrame, weights: DataFrame, *columns: str) -> DataFrame:
    """The weights' rows with the panel's rows of their ticker after rt and up to `until`: an equi-join on blocks of rows, so that a holding meets its own days and at most two blocks more."""
    block = lambda t: F.floor(t / BLOCK)
    prices = panel.select("ticker", "t", *columns, block(F.col("t")).alias("block"))
    spans = weights.withColumn("block", F.explode(F.sequence(block(F.col("rt") + 1), block(F.greatest(F.col("until"), F.col("rt") + 1)))))
    return spans.join(prices, ["ticker", "block"]).where((F.col("t") > F.col("rt")) & (F.col("t") <= F.col("until"))).drop("block")


def period_returns(panel: DataFrame, weights: DataFrame, keys: list[str], hold: str = "daily") -> DataFrame:
    """Logarithms of growth per (keys, rt) of weights (keys, rt, until, ticker, w) held from rt to `until`.

    'daily' puts the weights back every day; 'shares' lets them drift.
    """
    if hold == "daily":
        rows = held_prices(panel, weights, "ret")
        days = rows.groupBy(*keys, "rt", "t").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("r"))
        return days.groupBy(*keys, "rt").agg(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).alias("log_growth"), F.count("*").alias("days"))
    rows = held_prices(panel, weights, "close")
    base = panel.select("ticker", F.col("t").alias("rt"), F.col("close").alias("entry"))
    ends = rows.join(base, ["ticker", "rt"]).groupBy(*keys, "rt", "ticker").agg(F.max_by("close", "t").alias("exit"), F.first("entry").alias("entry"), F.first("w").alias("w"), F.count("*").alias("n"))
    return ends.groupBy(*keys, "rt").agg(F.ln(1 + F.sum(F.col("w") * (F.col("exit") / F.col("entry") - 1))).alias("log_growth"), F.max("n").alias("days"))


#: Positions of a ticker that one task takes.
ENTRY_PART = 100_000


def entry_days(positions: DataFrame, panel: DataFrame, within: float = 0.05) -> DataFrame:
    """(id, ticker, cost, entry): the first t at which the ticker's close stood within a share of the cost; where none did, the first of the nearest ones.

    positions: id, ticker, cost; panel: ticker, t, close. A position does not meet every day: a ticker's closes are sorted
    once a task, those near a cost are a run of them, found by bisection, and the least t of a run is read off a table of
    runs of 1, 2, 4, ... closes. A ticker's positions are dealt in parts of about ENTRY_PART.
    """
    rows = positions.select("id", "ticker", F.col("cost").cast("double").alias("cost")).distinct()
    parts = rows.groupBy("ticker").agg(F.ceil(F.count("*") / ENTRY_PART).cast("int").alias("parts"))
    dealt = rows.join(parts, "ticker").withColumn("part", F.pmod(F.xxhash64("id", "cost"), F.col("parts")).cast("int")).drop("parts")
    days = panel.where("close IS NOT NULL").groupBy("ticker", "close").agg(F.min(F.col("t").cast("long")).alias("t"))
    days = days.join(parts, "ticker").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def find(held: pa.Table, days: pa.Table) -> pa.Table:
        if not held.num_rows or not days.num_rows:
            return held.select(["id", "ticker", "cost"]).slice(0, 0).append_column("entry", pa.array([], pa.int64()))
        days = days.sort_by("close")
        costs = held.column("cost").to_pandas().to_numpy(float)  # NULL: no number
        entry = first_near(days.column("close").to_numpy(), days.column("t").to_numpy(), costs, within)
        return held.select(["id", "ticker", "cost"]).append_column("entry", pa.array(entry, pa.int64()))

    return dealt.groupBy("ticker", "part").cogroup(days.groupBy("ticker", "part")).applyInArrow(find, rows.schema.add("entry", "long"))


def first_near(closes: np.ndarray, days: np.ndarray, costs: np.ndarray, within: float) -> np.ndarray:
    """For each cost the least of `days` over the sorted `closes` with |close / cost - 1| <= within, over the nearest ones where there are none, over all where the cost is no number."""
    n = len(closes)
    table = [days]
    while (step := 1 << len(table)) <= n:
        table.append(np.minimum(table[-1][: n - step + 1], table[-1][step // 2 :]))
    entry = np.full(len(costs), days.min())
    at = np.flatnonzero(np.isfinite(costs))
    x = costs[at]

    def runs(low: np.ndarray, high: np.ndarray, inside) -> np.ndarray:
        """Least days of the runs [low, high] after their ends are moved to the closes that are inside; -1 for none."""
        while (more := (low > 0) & inside(np.maximum(low - 1, 0))).any():
            low = low - more
        while (more := (high < n - 1) & inside(np.minimum(high + 1, n - 1))).any():
            high = high + more
        while (less := (low <= high) & ~inside(np.minimum(low, n - 1))).any():
            low = low + less
        while (less := (low <= high) & ~inside(np.maximum(high, 0))).any():
            high = high - less
        some = low <= high
        level = np.frexp(np.maximum(high - low + 1, 1).astype(float))[1] - 1
        out = np.full(len(low), -1)
        for k in np.unique(level[some]):
            own = np.flatnonzero(some & (level == k))
            out[own] = np.minimum(table[k][low[own]], table[k][high[own] + 1 - (1 << int(k))])
        return out

    # below a cost of 0 no close is near; bounds in plain arithmetic may miss a close at the very edge, which runs() corrects
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        positive = x > 0
        low, high = np.searchsorted(closes, x * (1 - within)), np.searchsorted(closes, x * (1 + within), "right") - 1
        found = runs(np.where(positive, low, 0), np.where(positive, high, -1), lambda i: positive & (np.abs(closes[i] / x - 1) <= within))
        right = np.minimum(np.searchsorted(closes, x), n - 1)
        left = np.maximum(right - 1, 0)
        least = np.minimum(np.abs(closes[left] - x), np.abs(closes[right] - x))
        start = np.where(np.abs(closes[left] - x) == least, left, right)
        nearest = runs(start, start, lambda i: np.abs(closes[i] - x) <= least)
    entry[at] = np.where(found >= 0, found, nearest)
    return entry


#: Fixed values of the cost model: commission and fees a share, least commission an order, half spread, tax on gains, portfolio's money and a share's usual price.
PER_SHARE, PER_ORDER, HALF_SPREAD, TAX, MONEY, SHARE_PRICE = 0.0037, 0.35, 0.0005, 0.21, 50_000.0, 75.0


def trade_cost(moved: Column, sold_gain: Column) -> Column:
    """An aggregate over the tickers of one rebalance: its cost as a share of the portfolio, of absolute weight changes and of the weights sold times their gain; 0 for hardly any turnover."""
    turnover = F.sum(moved)
    commission = F.greatest(turnover * MONEY / SHARE_PRICE * PER_SHARE, F.sum((moved > 0.001).cast("long")) * PER_ORDER) / MONEY
    return F.when(turnover < 0.001, 0.0).otherwise(commission + turnover * HALF_SPREAD + F.sum(sold_gain) * TAX)


def rebalance_cost(old: DataFrame, new: DataFrame, per_side: float = 0.001, tax: float = 0.2) -> DataFrame:
    """(key, ticker, w, gain) before and (key, ticker, w) after: turnover times cost, and tax on the gains of what is sold."""
    both = old.join(new.withColumnRenamed("w", "w2"), ["key", "ticker"], "full_outer")
    moved = F.coalesce("w2", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))
    sold = F.greatest(-moved, F.lit(0.0))
    return both.groupBy("key").agg(F.sum(F.abs(moved)).alias("turnover"), F.sum(F.abs(moved) * per_side + sold * F.greatest(F.coalesce("gain", F.lit(0.0)), F.lit(0.0)) * tax).alias("cost"))


def walk(prices: np.ndarray, scores: np.ndarray, top: int, every: int, warm: int, stop: float, cool: int, target: float, cash_rate: float) -> np.ndarray:
    """Equity of one configuration over a small matrix: fixed-step rebalances into equal parts of the best `top` positive scores, marked daily, with a drawdown stop, a cool-down and volatility scaling of at least 0.20.

    A missing price is the last one before it; a ticker without any yet isn't bought. Only rows up to the current one are read: no later price can change an earlier equity.
    """
    n = len(prices)
    filled = pd.DataFrame(prices).ffill().to_numpy(float)
    daily = (1 + cash_rate) ** (1 / 252) - 1
    equity, cash, shares = np.ones(n), 1.0, np.zeros(prices.shape[1])
    peak, wait = 1.0, 0
    for t in range(1, n):
        cash *= 1 + daily
        live = np.where(np.isfinite(filled[t]), filled[t], 0.0)
        value = cash + float(shares @ live)
        equity[t] = value
        peak = max(peak, value)
        wait = max(0, wait - 1)
        if stop > 0 and shares.any() and value / peak - 1 < -stop:
            cash, shares, wait = value, np.zeros_like(shares), cool
        elif t >= warm and (t - warm) % every == 0 and wait == 0:
            s = np.where(np.isfinite(scores[t]) & (live > 0), scores[t], -np.inf)
            order = np.lexsort((np.arange(len(s)), -s))[:top]
            order = order[s[order] > 0]
            scale = 1.0
            if target > 0 and t > 20:
                vol = np.std(equity[t - 20 : t + 1][1:] / equity[t - 20 : t]) * 252**0.5
                scale = min(1.0, max(0.20, target / vol)) if vol > 0 else 1.0
            shares = np.zeros_like(shares)
            if len(order):
                shares[order] = value * scale / len(order) / live[order]
            cash = value - float(shares @ live)
    return equity


def rotation_targets(monthly: DataFrame, months: list[int], cash_below: float | None = None) -> DataFrame:
    """Per period the fund to hold: the best 12-1 momentum in the named months, kept until the next; cash where the best is below a bound."""
    w = Window.partitionBy("ticker").orderBy("period")
    mom = monthly.withColumn("mom", F.try_divide(F.lag("close", 1).over(w), F.lag("close", 12).over(w)) - 1)
    best = mom.groupBy("period").agg(F.max(F.when(F.col("mom").isNotNull(), F.struct("mom", "ticker"))).alias("b"))
    pick = F.when(F.month("period").isin(months) & F.col("b").isNotNull(), F.when(F.lit(cash_below).isNotNull() & (F.col("b.mom") < F.lit(cash_below or 0.0)), "CASH").otherwise(F.col("b.ticker")))
    return best.select("period", F.last(pick, ignorenulls=True).over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)).alias("fund"))


def taxed_sale(gain: Column, months_held: Column, exemption: float = 125_000.0) -> Column:
    """12.5% above the exemption from a year on, 20% before; losses owe nothing."""
    return F.when(gain <= 0, 0.0).when(months_held >= 12, 0.125 * F.greatest(gain - exemption, F.lit(0.0))).otherwise(0.20 * gain)

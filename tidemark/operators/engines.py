"""Strategies whose next step depends on their own equity. What doesn't (scores, gates, allocations, prices of what can be held) is made relationally; a grouped function walks each configuration over its own rows.

A configuration's rows are the days' prices of the tickers that it may ever hold,
so a task's memory follows from rebalances x positions, not from the universe, and
nothing is collected or broadcast: the rows reach the task by a co-grouped shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.allocation import cascade

YEAR = 252
#: Least gross exposure under volatility targeting; realised volatility below which it does nothing.
GROSS_FLOOR, LEAST_VOL = 0.20, 1e-4

Allocator = Callable[[DataFrame], DataFrame]


def equal_parts(offers: DataFrame) -> DataFrame:
    """An allocator: offers (config_id, rt, ticker, score, wt_mom and the configuration's columns) to (config_id, rt, ticker, w), shares of what is deployed."""
    out = cascade(offers, ["config_id", "rt"], 100_000.0, F.col("positions"), F.col("max_share"), F.col("min_share"), "equal")
    return out.select("config_id", "rt", "ticker", (F.col("alloc") / 100_000.0).alias("w"))


def held_rows(targets: DataFrame, market: DataFrame, first: DataFrame) -> DataFrame:
    """(config_id, t, ticker, close, calm) of each configuration's tickers from its first day (config_id, warm) on."""
    names = targets.select("config_id", "ticker").distinct().join(first, "config_id")
    return fresh(names.join(market, "ticker").where(F.col("t") >= F.col("warm")).select("config_id", "t", "ticker", "close", "calm"))


def fresh(frame: DataFrame) -> DataFrame:
    """The frame with columns of its own, so that it can be grouped beside one of the same origin."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


def _pivoted(prices: pd.DataFrame) -> tuple[np.ndarray, list[str], np.ndarray]:
    wide = prices.pivot(index="t", columns="ticker", values="close").sort_index().ffill()
    return wide.index.to_numpy(), list(wide.columns), wide.to_numpy(float)


class Book:
    """Cash and shares at one day's prices."""

    def __init__(self, cash: float, tickers: list[str]):
        self.cash, self.at, self.shares = cash, {t: i for i, t in enumerate(tickers)}, np.zeros(len(tickers))

    @property
    def invested(self) -> bool:
        return bool(self.shares.any())

    def value(self, prices: np.ndarray) -> float:
        held = np.flatnonzero(self.shares)
        return self.cash + float(self.shares[held] @ prices[held])

    def sell_all(self, prices: np.ndarray) -> None:
        self.cash = self.value(prices)
        self.shares[:] = 0.0

    def buy(self, prices: np.ndarray, weights: dict[str, float], money: float) -> None:
        """Holds the weights of `money`, borrowed beyond the book's value."""
        self.sell_all(prices)
        for ticker, w in weights.items():
            price = prices[self.at[ticker]]
            if np.isfinite(price) and price > 0:
                self.shares[self.at[ticker]] = w * money / price
                self.cash -= w * money


def fixed_steps(config: dict, days: np.ndarray, tickers: list[str], prices: np.ndarray, calm: np.ndarray, targets: dict[int, dict[str, float]], capital: float = 100_000.0) -> pd.DataFrame:
    """(step, equity, idle) of the engine with fixed rebalance steps: marked daily, cash earning a yearly rate, a drawdown stop with a cool-down, an exit when the regime turns, and exposure scaled to a target volatility of its own equity.

    config: every, stop, cool, target, vol_days, leverage, cash_rate, gated; targets: weights at rebalance days. Only days up to the current one are read.
    """
    rate = (1 + config["cash_rate"]) ** (1 / YEAR)
    book, equity, high = Book(capital, tickers), [capital], capital
    idle, out, until = [0.0], False, -1
    for i, day in enumerate(days):
        book.cash *= rate
        now = book.value(prices[i])
        equity.append(now)
        idle.append(float(not book.invested))
        high = max(high, now)
        stormy = config["gated"] and not calm[i]
        if book.invested and config["stop"] > 0 and now / high - 1 < -config["stop"]:
            out, until = True, i + config["cool"]
            book.sell_all(prices[i])
        if book.invested and stormy:
            out = True
            book.sell_all(prices[i])
        if i % config["every"] or (out and (i < until or stormy)):
            continue
        out, until = False, -1
        wanted = targets.get(int(day))
        if not wanted:
            continue
        scale = config["leverage"]
        if config["target"] > 0 and len(equity) > config["vol_days"]:
            recent = np.array(equity[-config["vol_days"] - 1 :])
            vol = float(np.std(np.diff(recent) / recent[:-1]) * YEAR**0.5)
            if vol > LEAST_VOL:
                scale = max(GROSS_FLOOR, min(1.0, config["target"] / vol) * config["leverage"])
        book.buy(prices[i], wanted, now * scale)
    return pd.DataFrame({"step": np.arange(len(equity)), "equity": equity, "idle": idle})


def run_fixed_steps(market: DataFrame, scores: DataFrame, grid: DataFrame, allocator: Allocator = equal_parts) -> DataFrame:
    """(config_id, step, equity, idle) for each row of grid (config_id, warm, every, positions, max_share, min_share, min_adv, floor, stop, cool, target, vol_days, leverage, cash_rate, gated).

    market: ticker, t, close, calm; scores: rt, ticker, score, wt_mom, adv60,
    current_dd at days that may be rebalances. Illiquid names and those deep below
    their high are not offered.
    """
    offers = scores.join(grid, (F.col("rt") >= F.col("warm")) & ((F.col("rt") - F.col("warm")) % F.col("every") == 0))
    offers = offers.where((F.col("adv60") >= F.col("min_adv")) & (F.col("current_dd") >= F.col("floor")))
    targets = allocator(offers).persist()  # a row a configuration, rebalance and position, read twice
    rows = held_rows(targets, market, grid.select("config_id", "warm"))
    knobs = ["every", "stop", "cool", "target", "vol_days", "leverage", "cash_rate", "gated"]
    wanted = fresh(targets.join(grid.select("config_id", *knobs), "config_id"))

    def run(key: tuple, chosen: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
        columns = ["config_id", "step", "equity", "idle"]
        if not len(chosen) or not len(prices):
            return pd.DataFrame({c: np.zeros(0, np.int64 if c in ("config_id", "step") else float) for c in columns})
        days, tickers, matrix = _pivoted(prices)
        calm = prices.groupby("t")["calm"].first().sort_index().to_numpy(bool)
        targets = {int(t): dict(zip(g["ticker"], g["w"], strict=True)) for t, g in chosen.groupby("rt")}
        out = fixed_steps(chosen.iloc[0][knobs].to_dict(), days, tickers, matrix, calm, targets)
        out.insert(0, "config_id", key[0])
        return out[columns]

    return wanted.groupBy("config_id").cogroup(rows.groupBy("config_id")).applyInPandas(run, "config_id long, step long, equity double, idle double")


#: How each mode scales the target volatility in a calm, middling and stormy market.
VOL_STATES = {"off": (1.0, 1.0, 1.0), "moderate": (1.30, 1.0, 0.60), "aggressive": (1.60, 1.0, 0.30), "defensive": (1.00, 0.7, 0.40)}
MOST_GROSS = 1.5


def wants_change(config: dict, held: list[str], top: list[str], score: dict[str, float], age: int, shift: int) -> bool:
    """Whether a portfolio of some age is put anew: never before the least hold, always after the longest (moved by `shift`), between them by the trigger."""
    if age < config["min_hold"]:
        return False
    if age >= config["max_hold"] + shift:
        return True
    if config["trigger"] == "name_change":
        return set(top) != set(held)
    if config["trigger"] == "score_gap":
        weakest = min((score[h] for h in held if score.get(h, 0.0) > 0), default=np.inf)
        best = max((score[t] for t in top if t not in held), default=-np.inf)
        return best >= weakest * (1 + config["gap"])
    return False


def checked(config: dict, days: np.ndarray, tickers: list[str], prices: np.ndarray, level: np.ndarray, below: np.ndarray, scale: np.ndarray, scores: dict[int, dict[str, float]], tops: dict[int, list[str]], first: int, cash: str | None = None) -> tuple[pd.DataFrame, dict]:
    """(step, equity) of the engine that looks every `check` days, and its counts of rebalances and mean hold.

    It leaves for cash below the market's mean (`below`) or after a drawdown stop,
    rebalances by wants_change, sizes by score, targets volatility (scaled by the
    market's state from its last 60 levels), multiplies by `scale` (a hidden-state
    factor of the day), and parks what is not invested in the cash ticker. Scores,
    levels and weights are of rows before the day. Weights are put back daily.
    """
    at = {t: i for i, t in enumerate(tickers)}
    growth = prices[1:] / prices[:-1] - 1
    equity, held, weights, age, wait = [1.0], [], np.zeros(0), 10**6, -1
    spells, changes, high, draw = [], 0, 1.0, config["seed"]
    start = int(np.searchsorted(days, first))
    for i in range(start, len(days), config["check"]):
        day = int(days[i])
        high = max(high, max(equity))
        if config["stop"] > 0 and len(equity) > 1 and equity[-1] / high - 1 <= -config["stop"] and wait < i:
            wait = i + max(config["max_hold"], 60)
        flee = bool(config["regime"] and below[i]) or i < wait
        top, score = tops.get(day, []), scores.get(day, {})
        if flee:
            if held and changes:
                spells.append(age)
            if held:
                held, weights, age = [], np.zeros(0), 0
        else:
            draw = (draw * 48271 + 11) % 2147483647
            shift = draw % (2 * config["jitter"] + 1) - config["jitter"] if config["jitter"] else 0
            if top and (not held or wants_change(config, held, top, score, age, shift)):
                if changes:
                    spells.append(age)
                held, age, changes = list(top), 0, changes + 1
                weights = sized_weights(config, np.array([score[t] for t in held]))
                columns = [at[t] for t in held]
                if config["target"] > 0 and i > config["vol_days"] + 5:
                    weights = weights * vol_scale(config, growth[i - config["vol_days"] : i - 1, columns] @ weights, level[max(0, i - 60) : i])
                weights = weights * scale[i]
                if weights.sum() > MOST_GROSS:
                    weights = weights * (MOST_GROSS / weights.sum())
        stop_at = min(i + config["check"], len(days))
        steps = growth[max(i - 1, 0) : stop_at - 1]
        move = steps[:, [at[t] for t in held]] @ weights if held else np.zeros(len(steps))
        if cash in at and cash not in held:
            move = move + max(0.0, 1.0 - float(weights.sum())) * steps[:, at[cash]]
        equity += list(equity[-1] * np.cumprod(1 + np.nan_to_num(move)))
        age += stop_at - i
    return pd.DataFrame({"step": np.arange(len(equity)), "equity": equity}), {"changes": changes, "mean_hold": float(np.mean(spells)) if spells else 0.0}


def sized_weights(config: dict, score: np.ndarray) -> np.ndarray:
    raw = np.maximum(score, 1e-6)
    raw = {"equal": np.ones(len(raw)), "score": raw, "sqrt_score": np.sqrt(raw)}[config["sizing"]]
    return raw / raw.sum()


def vol_scale(config: dict, returns: np.ndarray, level: np.ndarray) -> float:
    """What brings the basket's recent volatility to the target, which the market's own volatility moves."""
    target = config["target"]
    if config["vol_state"] != "off" and len(level) >= 30:
        market = float(np.std(np.diff(level) / level[:-1]) * YEAR**0.5)
        calm, usual, stormy = VOL_STATES[config["vol_state"]]
        target *= calm if market < 0.14 else stormy if market > 0.22 else usual
    vol = float(np.std(returns) * YEAR**0.5)
    return min(MOST_GROSS, target / vol) if np.isfinite(vol) and vol > LEAST_VOL else 1.0


CHECKED_KNOBS = ["check", "min_hold", "max_hold", "jitter", "trigger", "gap", "stop", "regime", "target", "vol_days", "vol_state", "sizing", "seed"]


def run_checked(market: DataFrame, scores: DataFrame, grid: DataFrame, first: int, cash: str | None = None) -> DataFrame:
    """(config_id, step, equity, changes, mean_hold) for each row of grid (config_id, positions and CHECKED_KNOBS).

    market: ticker, t, close, level, below, scale; scores: t, ticker, score, rank
    (rank by score within t, sub-caps applied). A configuration meets the scores of
    the tickers that are ever among its best, at its check days.
    """
    days = scores.join(grid.select("config_id", "positions", "check"), (F.col("t") >= first) & ((F.col("t") - first) % F.col("check") == 0))
    chosen = days.where(F.col("rank") <= F.col("positions")).select("config_id", "ticker").distinct()
    offers = days.join(chosen, ["config_id", "ticker"], "left_semi").select("config_id", "t", "ticker", "score", (F.col("rank") <= F.col("positions")).alias("top"), "rank").join(grid.select("config_id", *CHECKED_KNOBS), "config_id")
    names = chosen if cash is None else chosen.unionByName(grid.select("config_id", F.lit(cash).alias("ticker"))).distinct()
    rows = names.join(market, "ticker").select("config_id", "t", "ticker", "close", "level", "below", "scale")
    columns = ["config_id", "step", "equity", "changes", "mean_hold"]

    def run(key: tuple, offered: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
        if not len(offered) or not len(prices):
            return pd.DataFrame({c: np.zeros(0, float if c in ("equity", "mean_hold") else np.int64) for c in columns})
        at, tickers, matrix = _pivoted(prices)
        per = prices.groupby("t")[["level", "below", "scale"]].first().sort_index()
        live = offered[offered["score"] > 0]
        scores = {int(t): dict(zip(g["ticker"], g["score"], strict=True)) for t, g in offered.groupby("t")}
        tops = {int(t): list(g.sort_values("rank")["ticker"]) for t, g in live[live["top"]].groupby("t")}
        curve, counts = checked(offered.iloc[0][CHECKED_KNOBS].to_dict(), at, tickers, matrix, per["level"].to_numpy(float), per["below"].to_numpy(bool), per["scale"].to_numpy(float), scores, tops, first, cash)
        return curve.assign(config_id=key[0], **counts)[columns]

    return fresh(offers).groupBy("config_id").cogroup(fresh(rows).groupBy("config_id")).applyInPandas(run, "config_id long, step long, equity double, changes long, mean_hold double")

"""A Gaussian hidden Markov model with diagonal covariances, fitted by EM in numpy, one group a fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIN_ROWS, ITERATIONS, TOLERANCE = 504, 30, 1e-3


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (((x[:, None] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)


def _forward_backward(logb: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n, k = logb.shape
    top = logb.max(1, keepdims=True)
    b = np.exp(logb - top)
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a = start * b[t] if t == 0 else (alpha[t - 1] @ move) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta, joint = np.ones((n, k)), np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        joint += np.outer(alpha[t], b[t + 1] * beta[t + 1]) * move / scale[t + 1]
    return float(np.log(scale).sum() + top.sum()), alpha * beta, joint


def fit(x: np.ndarray, states: int = 3, seed: int = 42) -> dict | None:
    """Parameters with states ordered by the second feature's mean, highest first, and the likelihoods of the iterations; None for a short history."""
    if len(x) < MIN_ROWS:
        return None
    rng = np.random.default_rng(seed)
    order = np.argsort(x[:, -1], kind="stable")
    parts = np.array_split(order, states)[::-1]
    mean = np.array([x[p].mean(0) for p in parts]) + rng.normal(0, 1e-6, (states, x.shape[1]))
    var = np.array([x[p].var(0) + 1e-6 for p in parts])
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    seen: list[float] = []
    for _ in range(ITERATIONS):
        like, gamma, joint = _forward_backward(_log_density(x, mean, var), start, move)
        seen.append(like)
        if len(seen) > 1 and seen[-1] - seen[-2] < TOLERANCE:
            break
        start, move = gamma[0], joint / joint.sum(1, keepdims=True)
        mass = gamma.sum(0)[:, None]
        mean = gamma.T @ x / mass
        var = np.maximum(gamma.T @ (x * x) / mass - mean**2, 1e-8)
    rank = np.argsort(-mean[:, -1], kind="stable")
    return {"start": start[rank], "move": move[rank][:, rank], "mean": mean[rank], "var": var[rank], "likelihood": seen}


def predict(model: dict | None, x: np.ndarray, window: int = 252) -> int:
    """The likeliest last state over the trailing window; -1 without a model."""
    if model is None or not len(x):
        return -1
    _, gamma, _ = _forward_backward(_log_density(x[-window:], model["mean"], model["var"]), model["start"], model["move"])
    return int(gamma[-1].argmax())


def regimes(features: DataFrame, every: int = 252, states: int = 3) -> DataFrame:
    """(ticker, t, state) at refits every `every` rows, from rows up to t only. features: ticker, t, f0, f1 (volatility last); NaN and NULL count as 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = np.nan_to_num(frame[["f0", "f1"]].to_numpy(float))
        at = list(range(MIN_ROWS, len(x) + 1, every))
        state = [predict(fit(x[:n], states), x[:n]) for n in at]
        return pd.DataFrame({"ticker": frame["ticker"].iloc[0], "t": [int(frame["t"].iloc[n - 1]) for n in at], "state": state})

    return features.groupBy("ticker").applyInPandas(run, "ticker string, t long, state long")

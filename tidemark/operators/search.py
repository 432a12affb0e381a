"""Search over configurations: a sampler, one-field changes with repair, and a loop over batches that are evaluated as rows. The proposals of a batch come from the driver; scoring them is a Spark job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the search space.
SPACE: dict[str, list] = {
    "lookbacks": [(21, 63, 252), (42, 126, 252), (63, 126, 252), (126, 252, 504), (252, 504, 756), (252, 504, 1260), (504, 756, 1260)],
    "weights": [(0.7, 0.2, 0.1), (0.5, 0.3, 0.2), (0.4, 0.4, 0.2), (0.3, 0.3, 0.3), (0.1, 0.3, 0.6)],
    "variant": ["sortino_pricemom", "sortino_vnorm", "martin", "wtmf", "baltas"],
    "positions": [3, 4, 5, 7, 10, 15, 20, 25, 30, 50],
    "trigger": ["fixed", "name_change", "score_gap"],
    "min_hold": [15, 20, 25, 30],
    "max_hold": [35, 40, 50, 60, 80],
    "gap": [0.05, 0.10, 0.25],
    "crash": [0.5, 1.0],
    "regime_days": [0, 100, 150, 200],
    "stop": [0.0, 0.15, 0.30],
    "target": [0.0, 0.15, 0.20, 0.25],
    "sizing": ["equal", "score", "sqrt_score"],
    "vol_days": [21, 42, 63],
    "vol_state": ["off", "moderate", "aggressive", "defensive"],
    "states": [0, 2, 3],
    "profile": ["balanced", "aggressive", "defensive"],
    "feature_days": [21, 42, 63],
    "refit_days": [252, 504, 756],
    "apply": ["gross", "target_vol"],
}
#: Chances: of a fresh sample in place of a change, of a base from the log's best in place of the best of all; how many of the log's best, and how many of them must be any good.
FRESH, FROM_LOG, LOG_TOP, LOG_LEAST = 0.40, 0.50, 20, 5
#: Days that the longest hold must be above the least.
HOLD_ROOM = 20


@dataclass(frozen=True)
class Candidate:
    lookbacks: tuple = (63, 126, 252)
    weights: tuple = (0.4, 0.4, 0.2)
    variant: str = "sortino_pricemom"
    positions: int = 5
    trigger: str = "fixed"
    min_hold: int = 20
    max_hold: int = 60
    gap: float = 0.1
    crash: float = 1.0
    regime_days: int = 0
    stop: float = 0.0
    target: float = 0.0
    sizing: str = "equal"
    vol_days: int = 42
    vol_state: str = "off"
    states: int = 0
    profile: str = "off"
    feature_days: int = 21
    refit_days: int = 252
    apply: str = "off"


def repaired(c: Candidate, draw: Callable[[str], object]) -> Candidate:
    """Holds in order, and hidden-state settings only with hidden states."""
    if c.min_hold >= c.max_hold:
        c = replace(c, max_hold=c.min_hold + HOLD_ROOM)
    if not c.states:
        return replace(c, profile="off", apply="off")
    missing = {k: draw(k) for k in ("profile", "apply") if getattr(c, k) == "off"}
    return replace(c, **missing)


def sampled(rng: np.random.Generator) -> Candidate:
    draw = lambda name: SPACE[name][int(rng.integers(len(SPACE[name])))]
    return repaired(Candidate(**{name: draw(name) for name in SPACE}), draw)


def mutated(base: Candidate, rng: np.random.Generator) -> Candidate:
    """The base with one field drawn anew."""
    draw = lambda name: SPACE[name][int(rng.integers(len(SPACE[name])))]
    name = list(SPACE)[int(rng.integers(len(SPACE)))]
    return repaired(replace(base, **{name: draw(name)}), draw)


@dataclass
class Log:
    """What was tried: (iteration, origin, candidate, score)."""

    rows: list[tuple[int, str, Candidate, float]] = field(default_factory=list)

    def ends(self, top: int, bottom: int) -> tuple[list, list]:
        order = sorted(self.rows, key=lambda r: (-r[3], r[0]))
        return order[:top], order[len(order) - bottom :] if bottom else []

    @property
    def best(self) -> tuple | None:
        return self.ends(1, 0)[0][0] if self.rows else None

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row a candidate: iter, origin, score and s_<field>, arrays as text."""
        flat = [{"iter": i, "origin": o, "score": s} | {f"s_{k}": ",".join(map(str, v)) if isinstance(v, tuple) else v for k, v in asdict(c).items()} for i, o, c, s in self.rows]
        return spark.createDataFrame(flat)


def proposal(log: Log, pending: list[Candidate], rng: np.random.Generator) -> tuple[str, Candidate]:
    if pending:
        return "proposed", pending.pop(0)
    if log.best is None or rng.random() < FRESH:
        return "random", sampled(rng)
    good = [r for r in log.ends(LOG_TOP, 0)[0] if r[3] > 0]
    base = good[int(rng.integers(len(good)))] if len(good) >= LOG_LEAST and rng.random() < FROM_LOG else log.best
    return "changed", mutated(base[2], rng)


def run(evaluate: Callable[[list[Candidate]], list[float]], iterations: int, batch: int = 25, seed: int = 42, pending: list[Candidate] | None = None, callback: Callable[[int, list, list], list[Candidate]] | None = None, done: Callable[[Log], bool] | None = None) -> Log:
    """Evaluates batches of proposals till `iterations` or till `done`. The callback sees the log's ends after each batch and may add proposals of its own."""
    rng, log, pending = np.random.default_rng(seed), Log(), list(pending or [])
    while len(log.rows) < iterations:
        chosen = [proposal(log, pending, rng) for _ in range(min(batch, iterations - len(log.rows)))]
        scores = evaluate([c for _, c in chosen])
        log.rows += [(len(log.rows) + k + 1, o, c, float(s)) for k, ((o, c), s) in enumerate(zip(chosen, scores, strict=True))]
        if done and done(log):
            break
        if callback and len(log.rows) < iterations:
            pending += callback(len(log.rows), *log.ends(10, 5))
    return log


def reached(pain_ratio: Column, months: Column, cagr: Column, rebalances: Column) -> Column:
    """Whether a result meets all of the loop's targets."""
    return (pain_ratio >= 8) & (months <= 20) & (cagr >= 0.30) & (rebalances >= 30)


def cross_regime(bull: Column, neutral: Column, bear: Column, shock: Column, oos: Column, martin: Column) -> Column:
    """Lower-quartile growth over the regimes, the bear counted twice, with out-of-sample growth and a little of the Martin ratio."""
    return (bull + neutral + 2 * bear + shock) / 5 * 100 + oos * 50 + martin * 2


def best_record(logs: DataFrame, score: str = "score") -> DataFrame:
    """The one row of the highest score over all logs, the earliest of equals."""
    return logs.where(F.col(score).isNotNull()).orderBy(F.desc(score), "tag", "iter").limit(1)


def halves(panel: DataFrame, share: float = 0.67, warm: int = 252) -> tuple[DataFrame, DataFrame]:
    """Rows to train on, and rows to test on with `warm` days of overlap before them, by the calendar."""
    last = panel.agg(F.max("t").alias("last"))
    rows = panel.join(F.broadcast(last), how="cross").withColumn("cut", F.floor(F.col("last") * share))  # one row
    return rows.where("t <= cut").drop("last", "cut"), rows.where(F.col("t") > F.col("cut") - warm).drop("last", "cut")

"""A quality classifier: a sparse ensemble of rules.

Trees grown on bootstrap samples of document statistics give their paths as
conjunctive rules; a lasso logistic regression over the rules keeps a few, and
those become one Spark column expression, a sum of weights under a logistic
function. Training takes a bounded sample of labelled rows to the driver, as
statistics, never texts.

Edge cases: a null or empty text has zero statistics and a score; an
unlabelled row takes no part in training; with one class, or none, the score is
that of the intercept; rows may repeat; an empty table gives an empty one;
clashing column names don't matter, as statistics are computed under their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import statistics

#: Labelled rows at most, those of least id hash.
MAX_ROWS = 8000
TREES, DEPTH, CUTS, LEAF = 24, 3, 24, 12
PENALTY, ROUNDS = 0.002, 400
FEATURES = {
    "n_words": "n_words",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}

Condition = tuple[int, bool, float]  # feature, whether above, cut


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The rules as one expression over the columns of FEATURES."""
        names = list(FEATURES)
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for feature, above, cut in rule:
                holds = holds & ((F.col(names[feature]) > cut) if above else (F.col(names[feature]) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(x: np.ndarray, y: np.ndarray, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The conjunctions on the way to every node below the root of a tree grown by Gini gain."""
    found = [path] if path else []
    if len(path) == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return found
    best, chosen = 1e-9, None
    base = len(y) * y.mean() * (1 - y.mean())
    for feature in range(x.shape[1]):
        column = x[:, feature]
        for cut in np.unique(np.quantile(column, np.linspace(0.02, 0.98, CUTS))):
            above = column > cut
            n = above.sum()
            if n < LEAF or len(y) - n < LEAF:
                continue
            a, b = y[above].mean(), y[~above].mean()
            gain = base - n * a * (1 - a) - (len(y) - n) * b * (1 - b)
            if gain > best:
                best, chosen = gain, (feature, float(cut), above)
    if chosen is None:
        return found
    feature, cut, above = chosen
    return found + paths(x[above], y[above], (*path, (feature, True, cut))) + paths(x[~above], y[~above], (*path, (feature, False, cut)))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, cut in rule:
        out &= (x[:, feature] > cut) if above else (x[:, feature] <= cut)
    return out


def lasso(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, k = a.shape
    a1 = np.hstack([a, np.ones((n, 1))])
    step = 4 * n / max(np.linalg.norm(a1, 2) ** 2, 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(a1 @ z, -30, 30)))
        u = z - step * (a1.T @ (p - y)) / n
        u[:k] = np.sign(u[:k]) * np.maximum(np.abs(u[:k]) - step * PENALTY, 0)
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = u + (t - 1) / t1 * (u - w), u, t1
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        rate = 0.5 if len(y) == 0 else (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel((), (), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        some = rng.choice(len(y), min(len(y), 2000))
        features = np.sort(rng.choice(x.shape[1], max(3, x.shape[1] - 2), replace=False))
        for rule in paths(x[some][:, features], y[some]):
            rules[tuple((int(features[f]), above, cut) for f, above, cut in rule)] = None
    kept, columns, seen = [], [], set()
    for rule in rules:  # rules that hold for the same rows count once
        column = holds(rule, x)
        if 0 < column.sum() < len(y) and (key := column.tobytes()) not in seen:
            seen.add(key)
            kept.append(rule)
            columns.append(column)
    if not kept:
        return RuleModel((), (), float(np.log(y.mean() / (1 - y.mean()))))
    w, intercept = lasso(np.array(columns, float).T, y.astype(float))
    used = [i for i in range(len(kept)) if abs(w[i]) > 1e-6]
    return RuleModel(tuple(kept[i] for i in used), tuple(float(w[i]) for i in used), intercept)


def featured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return statistics(docs, text_col, keep).select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """`labels`: the rows that may be learnt from. The sample of ids is bounded by MAX_ROWS, so its join is broadcast."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # of rows with one id the least text, so that the sample is the same on every run
    found = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = featured(found, "text", ["doc_id", "y"]).toPandas().sort_values("doc_id")
    return fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def classify(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return featured(named, "text", ["doc_id"]).select("doc_id", model.score().alias("score"))

"""Quality classifier as a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded labelled sample; every path from a root is a rule, a
conjunction of comparisons; a lasso logistic regression weighs the rules and drops most; those
left are compiled into one Spark expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.frames import attach, once
from tablescout.llm.text_stats import (
    CLASSES,
    character_counts,
    repeated_lines,
    repeated_words,
    split_words,
)

SAMPLE_ROWS = 20_000  # labelled rows that are used for fitting, about
TREES, DEPTH, LEAST_LEAF, CUTS = 24, 3, 10, 32
RATE = 0.3  # of each tree in the boosting
PENALTY = 0.002  # of the lasso, relative to the mean loss
STEPS = 2000

STATISTICS = [
    *(f"share_{c}" for c in CLASSES),
    "log_words", "word_length", "distinct_words", "repeated_words", "repeated_lines",
    "words_per_line", "short_words", "symbols_per_word", "upper_words", "marks_per_word",
]


def statistics(texts: pd.Series) -> pd.DataFrame:
    """Statistics of each whole text; all are 0 for an empty or null one."""
    whole = [t or "" for t in texts]
    counts, in_words, symbols = character_counts(whole)
    out = np.zeros((len(whole), len(STATISTICS)))
    out[:, : len(CLASSES)] = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    for i, text in enumerate(whole):
        words = split_words(text)
        n = max(1, len(words))
        copies, lines = repeated_lines(text)
        out[i, len(CLASSES) :] = [
            np.log1p(len(words)),
            in_words[i] / n,
            len(set(words)) / n,
            repeated_words(words) / n,
            copies / max(1, lines),
            np.log1p(len(words) / max(1, lines)),
            sum(len(w) <= 3 for w in words) / n,
            symbols[i] / n,
            sum(map(str.isupper, words)) / n,
            counts[i, CLASSES.index("mark")] / n,
        ]
    return pd.DataFrame(out, columns=STATISTICS)


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, above, threshold) does: over it, or at most it."""

    tests: tuple[tuple[int, bool, float], ...]

    def on(self, rows: np.ndarray) -> np.ndarray:
        held = np.ones(len(rows), bool)
        for k, above, cut in self.tests:
            held &= (rows[:, k] > cut) == above
        return held

    def column(self, of) -> Column:
        """The rule as a Spark condition; ``of`` gives the column of a statistic."""
        return reduce(
            lambda a, b: a & b,
            [of(k) > cut if above else of(k) <= cut for k, above, cut in self.tests],
        )


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float


def _grow(rows, target, cuts, tests, depth, found, out, index):
    """One regression tree; appends the path of every node but the root to ``found``."""
    best = (1e-9, None)
    total, n = target[index].sum(), len(index)
    if depth and n >= 2 * LEAST_LEAF:
        for k, points in enumerate(cuts):
            if not len(points):
                continue
            place = np.searchsorted(points, rows[index, k], side="left")
            left_n = np.cumsum(np.bincount(place, minlength=len(points) + 1))[:-1]
            left = np.cumsum(np.bincount(place, target[index], minlength=len(points) + 1))[:-1]
            fits = (left_n >= LEAST_LEAF) & (n - left_n >= LEAST_LEAF)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n
            gain[~fits] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (k, float(points[i])))
    if best[1] is None:
        out[index] = total / max(1, n)
        return
    k, cut = best[1]
    above = rows[index, k] > cut
    for side in (False, True):
        path = (*tests, (k, side, cut))
        found.append(Rule(path))
        _grow(rows, target, cuts, path, depth - 1, found, out, index[above == side])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rules(rows: np.ndarray, labels: np.ndarray) -> RuleModel:
    """Rules and lasso weights from a sample; only an intercept where one class is missing."""
    base = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    if len(set(labels.tolist())) < 2:
        return RuleModel((), (), base)
    points = np.linspace(0, 1, CUTS + 2)[1:-1]
    cuts = [np.unique(np.quantile(rows[:, k], points)) for k in range(rows.shape[1])]
    score, found = np.full(len(rows), base), []
    for _ in range(TREES):
        step = np.zeros(len(rows))
        residual = labels - _sigmoid(score)
        _grow(rows, residual, cuts, (), DEPTH, found, step, np.arange(len(rows)))
        score += RATE * 4 * step
    rules = list(dict.fromkeys(found))
    held = np.array([r.on(rows) for r in rules], float).T
    keep = (held.mean(axis=0) > 0) & (held.mean(axis=0) < 1)
    held, rules = held[:, keep], [r for r, k in zip(rules, keep, strict=True) if k]
    # Accelerated proximal gradient; the intercept is not penalised.
    bound = 0.25 * (np.linalg.norm(held, 2) ** 2 / len(rows) + 1)
    weights, b = np.zeros(held.shape[1]), base
    ahead, ahead_b, t = weights, b, 1.0
    for _ in range(STEPS):
        error = _sigmoid(held @ ahead + ahead_b) - labels
        new = ahead - held.T @ error / len(rows) / bound
        new = np.sign(new) * np.maximum(0, np.abs(new) - PENALTY / bound)
        new_b = ahead_b - error.mean() / bound
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / later
        ahead, ahead_b = new + push * (new - weights), new_b + push * (new_b - b)
        weights, b, t = new, new_b, later
    used = np.flatnonzero(weights)
    return RuleModel(
        tuple(rules[i] for i in used), tuple(float(weights[i]) for i in used), float(b)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE_ROWS,
) -> RuleModel:
    """Model from about ``sample`` labelled documents, drawn by a hash of their ids.

    Labels other than 0 and 1, and null ids, are not used; a repeated document counts
    once, an id of several texts with that of the smallest hash.
    Only the sampled ids are sent to all tasks, and only statistics reach the driver.
    """
    given = labels.select(F.col(f"`{id}`").alias("_i"), F.col(f"`{label}`").alias("_y")).where(
        "_i is not null and _y in (0, 1)"
    )
    count = given.count()
    whole = 1 << 30
    part = int(whole * min(1.0, sample / max(1, count)))
    drawn = given.where(F.pmod(F.xxhash64("_i"), F.lit(whole)) <= part).groupBy("_i").agg(F.max("_y").alias("_y"))
    # About ``sample`` rows of an id and a label: a bound that does not grow with the corpus.
    rows = (
        docs.select(F.col(f"`{id}`").alias("_i"), F.col(f"`{text}`").alias("_t"))
        .join(F.broadcast(drawn), "_i")
        .select("_i", "_y", F.xxhash64("_t").alias("_h"), once(statistics, _KIND)("_t").alias("_s"))
        # Of an id with several texts that of the smallest hash counts, wherever it stands.
        .groupBy("_i")
        .agg(F.max("_y").alias("_y"), F.min_by("_s", "_h").alias("_s"))
        .select("_i", "_y", "_s.*")
        .toPandas()
        .sort_values("_i")
    )
    return fit_rules(rows[STATISTICS].to_numpy(float), rows["_y"].to_numpy(float))


_KIND = ", ".join(f"{c} double" for c in STATISTICS)


def score(
    df: DataFrame, model: RuleModel, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """``df`` (or ``columns`` of it) with score (0 to 1) and predicted (1 from 0.5 on).

    Every whole text is scored; a null one as an empty one. Input columns of the result names
    are replaced; repeated rows stay.
    """
    results = ["score", "predicted"]
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in results]
    held = attach(df, {"_stats": once(statistics, _KIND)(F.col(f"`{text}`"))}, kept)

    def of(k: int) -> Column:
        return F.col(f"_stats.{STATISTICS[k]}")

    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
    scored = held.withColumn("_score", 1 / (1 + F.exp(-total)))
    return scored.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )

"""Quality of texts by a sparse ensemble of rules.

Statistics of a text are Spark column expressions. Shallow trees are boosted on a bounded sample of labelled rows; each
path from a root is a rule: a conjunction of bounds on statistics. A logistic model with an L1 penalty weighs the
rules, most of which get no weight, and the rest is compiled into one column expression.

Results for odd input: null and empty texts have statistics of 0; if the labels hold one class only or are empty, every
score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, without

#: Labelled rows that the rules are fitted on, about; chosen by a hash of the id, the same on every run.
LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 24, 3, 0.3, 32, 20
PENALTY, STEPS = 0.0005, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text: shares of signs, and of words, lines and their repetition."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(whole), F.lit(1))
    words, lines = F.split(F.trim(whole), r"[ \t\n\r\f]+"), F.split(whole, r"\n+")
    n_words, n_lines = F.size(words), F.size(lines)

    def share(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)) / chars

    return {
        "log_words": F.log(n_words),
        "chars_a_word": F.length(whole) / n_words,
        "upper": share(r"\p{Lu}"),
        "signs": share(r"[^\p{L}\p{N}\s.,]"),
        "stops": share(r"[.,]"),
        "digits": share(r"[0-9]"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_a_line": n_words / n_lines,
        "signed_words": F.regexp_count(whole, F.lit(r"[^\p{L}\p{N}\s.,](?=\s|$)")) / n_words,
    }


Bound = tuple[str, bool, float]


@dataclass(frozen=True)
class Rules:
    """bias and weighted rules; a rule is a conjunction of (statistic, whether it is above, bound)."""

    bias: float
    rules: tuple[tuple[float, tuple[Bound, ...]], ...]

    def logit(self, columns: dict[str, Column]) -> Column:
        """The rules as one column expression over columns of statistics."""
        total = F.lit(self.bias)
        for weight, bounds in self.rules:
            holds = F.lit(True)
            for name, above, bound in bounds:
                holds = holds & ((columns[name] > bound) if above else (columns[name] <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bounds: list[np.ndarray], rows: np.ndarray, depth: int, path, out) -> np.ndarray:
    """Grow a tree on binned rows, add its paths to out, and return the values of its leaves for all rows."""
    value = np.zeros(len(x))
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for j in range(x.shape[1]):
            at = x[rows, j]
            gs, hs, ns = (np.bincount(at, w, BINS + 1).cumsum() for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = 0
            k = int(gain[: len(bounds[j])].argmax()) if len(bounds[j]) else 0
            if len(bounds[j]) and gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        value[rows] = -g / (h + 1)
        return value
    j, k = best[1]
    for above in (False, True):
        side = rows[(x[rows, j] > k) == above]
        longer = (*path, (j, above, k))
        out.append(longer)
        value += _grow(x, gradient, hessian, bounds, side, depth - 1, longer, out)
    return value


def fit(values: np.ndarray, labels: np.ndarray, names: list[str]) -> Rules:
    """Boost trees, take their paths as rules, and weigh these with an L1 penalty (proximal gradient steps)."""
    good = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or good in (0.0, 1.0):
        good = min(max(good, 1e-3), 1 - 1e-3)
        return Rules(math.log(good / (1 - good)), ())
    bounds = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(values.shape[1])]
    x = np.stack([np.searchsorted(b, values[:, j], "left") for j, b in enumerate(bounds)], 1)
    bias = math.log(good / (1 - good))
    logit = np.full(len(labels), bias)
    paths: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        logit += RATE * _grow(x, p - labels, p * (1 - p), bounds, np.arange(len(labels)), DEPTH, (), paths)
    paths = list(dict.fromkeys(paths))
    if not paths:
        return Rules(bias, ())
    holds = np.stack([np.all([(x[:, j] > k) == above for j, above, k in path], 0) for path in paths], 1).astype(np.float64)
    weights, w0 = np.zeros(len(paths)), bias
    step = 4 * len(labels) / (np.linalg.norm(np.column_stack((holds, np.ones(len(labels)))), 2) ** 2)
    look, look0, t = weights, w0, 1.0
    for _ in range(STEPS):
        wrong = (1 / (1 + np.exp(-(holds @ look + look0))) - labels) / len(labels)
        new = look - step * (holds.T @ wrong)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new0 = look0 - step * wrong.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, look0 = new + (t - 1) / t2 * (new - weights), new0 + (t - 1) / t2 * (new0 - w0)
        weights, w0, t = new, new0, t2
    kept = [(round(float(w), 6), tuple((names[j], above, float(bounds[j][k])) for j, above, k in path)) for w, path in zip(weights, paths) if abs(w) > 1e-4]
    return Rules(round(float(w0), 6), tuple(kept))


def learn(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED,
) -> Rules:
    """Rules from about `most` labelled rows at most; only their statistics reach the driver."""
    rows = labelled_sample(documents.select(key, F.col(text).alias("t")), labels, key, label, most)
    told = statistics(F.col("t"))
    found = rows.select(F.col(label).alias("y"), *[c.cast("double").alias(n) for n, c in told.items()]).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")
    return fit(found[list(told)].to_numpy(np.float64), found["y"].to_numpy(np.float64), list(told))


def with_quality(df: DataFrame, rules: Rules, text: str = "text", least: float = 0.3) -> DataFrame:
    """df with score and predicted (1 from `least` on); columns of df with these names are replaced.

    The statistics that rules use are columns of their own, so each is computed once for a text; they are dropped again.
    A row number among them keeps a caller's filter on the score above them: pushed below, it would hold each statistic's
    expression once for every bound of a rule.
    """
    used = {name for _, bounds in rules.rules for name, _, _ in bounds}
    told = {f"__told_{n}": c for n, c in statistics(F.col(text)).items() if n in used} | {"__told": F.monotonically_increasing_id()}
    out = without(df.withColumns(told), "score", "predicted")
    logit = rules.logit({n: F.col(f"__told_{n}") for n in used})
    out = out.withColumn("score", F.when(F.col("__told") >= 0, 1 / (1 + F.exp(-logit)))).drop(*told)
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))

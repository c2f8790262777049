"""A quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small trees are boosted on the labelled sample; each path from a root is a rule, a conjunction of comparisons of
statistics with thresholds. A logistic regression with an absolute penalty keeps a few of the rules, and those compile into one Spark
column: a document's score is computed where its text is, without Python.

The fit takes a bounded sample of the labelled rows, the `sample` first by a hash of the id; that is the parameter of the fit. All rows are
scored over whole texts.

Null and empty texts have zero statistics and the score of those; without labelled rows, or with one label alone, the score is the
smoothed share of label 1; null labels teach nothing; repeated rows each get their result and repeated labels count each;
a score of exactly the threshold counts as 1; a text's words are an array in one row, some 50 bytes for each word of a long one; a table without rows gives none; columns beside doc_id, text and quality play no part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, split_of
from .text_stats import SYMBOLS, UPPER, count_of, with_words

SAMPLE = 20_000
TREES, DEPTH, LEAF, RATE = 40, 3, 12, 0.3
CUTS = 48
#: predicted is 1 from this score on.
THRESHOLD = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over the threshold, threshold)


def statistics() -> dict[str, Column]:
    """By name, over the columns of with_words; 0 where a text has no words."""
    text, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    n, chars, rows = F.greatest(F.size(words), F.lit(1)), F.greatest(F.char_length(text), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    return {
        "words": F.size(words).cast("double"),
        "word_chars": chars / n,
        "upper": count_of(text, UPPER) / chars,
        "shouts": count_of(text, "!") / n,
        "symbols": count_of(text, SYMBOLS) / n,
        "bars": count_of(text, "|") / n,
        "stops": count_of(text, ".") / n,
        "commas": count_of(text, ",") / n,
        "digits": count_of(text, "0123456789") / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeated_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / rows,
        "line_words": F.size(words) / rows,
    }


#: The statistics, in order.
NAMES = ("words", "word_chars", "upper", "shouts", "symbols", "bars", "stops", "commas", "digits", "distinct_words", "repeated_lines", "line_words")


def with_statistics(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return with_words(docs, columns).select(*columns, *(c.cast("double").alias(f"__{k}") for k, c in statistics().items()))


def _tree(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, own: np.ndarray, depth: int, path: Rule) -> list[tuple[Rule, np.ndarray]]:
    """Paths of a least-squares tree, with the rows in each; the leaves' mean is the caller's to take."""
    best: tuple[float, int, float] | None = None
    y = target[own]
    for k, at in enumerate(cuts):
        if not len(at) or depth == 0 or len(own) < 2 * LEAF:
            continue
        bin_of = np.searchsorted(at, x[own, k], "left")  # values up to at[j] have bins up to j
        n = np.cumsum(np.bincount(bin_of, minlength=len(at) + 1))[:-1]
        s = np.cumsum(np.bincount(bin_of, y, len(at) + 1))[:-1]
        m = len(own) - n
        gain = np.where((n >= LEAF) & (m >= LEAF), s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(m, 1), -np.inf)
        j = int(gain.argmax())
        if best is None or gain[j] > best[0]:
            best = float(gain[j]), k, float(at[j])
    if best is None or best[0] <= y.sum() ** 2 / max(len(y), 1) + 1e-9:
        return [(path, own)]
    _, k, at = best
    over = x[own, k] > at
    inner = [(path, own)] if path else []
    return inner + _tree(x, cuts, target, own[~over], depth - 1, (*path, (k, False, at))) + _tree(x, cuts, target, own[over], depth - 1, (*path, (k, True, at)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, at in rule:
        out &= (x[:, k] > at) == over
    return out


def rules_of(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The different paths of boosted trees."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf")) for k in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.unique(x[:, k][x[:, k] < np.inf])[:1]])) for k, c in enumerate(cuts)]
    f = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        own = np.flatnonzero(random.random(len(y)) < 0.5)
        some = set(random.permutation(x.shape[1])[: max(4, x.shape[1] // 2)].tolist())
        paths = _tree(x, [c if k in some else c[:0] for k, c in enumerate(cuts)], y - p, own, DEPTH, ())
        inner = {path[:k] for path, _ in paths for k in range(len(path))}
        for path, rows in paths:
            if path:
                found[path] = None
                if path not in inner and len(rows):  # a leaf
                    step = float((y - p)[rows].sum() / max((p * (1 - p))[rows].sum(), 1e-3))
                    f[holds(path, x)] += RATE * min(max(step, -4), 4)
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an absolute penalty on the weights, by accelerated proximal steps."""
    z = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(z.shape[1])
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    size = 4 * len(y) / max(float(np.linalg.norm(z, 2)) ** 2, 1e-9)
    ahead, t = w, 1.0
    for _ in range(steps):
        gradient = z.T @ (1 / (1 + np.exp(-(z @ ahead))) - y) / len(y)
        new = ahead - size * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        next_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / next_t * (new - w)
        w, t = new, next_t
    return float(w[0]), w[1:]


class RuleEnsemble:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if len(y) == 0 or y.min() == y.max():
            return cls(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
        rules = rules_of(x, y)
        if not rules:
            return cls(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
        z = np.column_stack([holds(r, x) for r in rules]).astype(np.float64)
        part = np.arange(len(y)) % 5 == 0
        losses = {}
        for penalty in (0.0005, 0.001, 0.002, 0.005, 0.01):
            b, w = lasso(z[~part], y[~part], penalty, 150)
            s = b + z[part] @ w
            losses[penalty] = float(np.mean(np.logaddexp(0, s) - y[part] * s))
        least = min(losses.values())
        b, w = lasso(z, y, max(p for p, v in losses.items() if v <= 1.05 * least + 1e-6))
        return cls(b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            s += w * holds(rule, x)
        return 1 / (1 + np.exp(-s))

    def column(self) -> Column:
        """The score over the columns of with_statistics."""
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for k, over, at in rule:
                c = F.col(f"__{NAMES[k]}")
                test = test & ((c > at) if over else (c <= at))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """From the labels whose id isn't held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("__quality")).filter(F.col("__quality").isin(0, 1) & F.col("doc_id").isNotNull() & (split_of(F.col("doc_id"), 5) != 0))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "__quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    stats = with_statistics(rows, ("doc_id", "__quality"))
    data = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *(f"__{n}" for n in NAMES)).limit(sample).toPandas()
    return RuleEnsemble.fit(data[[f"__{n}" for n in NAMES]].to_numpy(np.float64).reshape(len(data), len(NAMES)), data["__quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: RuleEnsemble, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, score and predicted of each row; the text may be among the columns."""
    names = {c: f"c{k}" for k, c in enumerate(columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), "text")
    out = with_statistics(rows, tuple(names.values())).withColumn("score", model.column())
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1."""
    moved, back = aside(docs, "text")
    return back(scored(moved, fit(docs, labels), tuple(moved.columns)).filter("predicted = 1"))

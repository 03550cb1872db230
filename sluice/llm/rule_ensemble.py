"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

Shallow trees, boosted on a bounded sample of labelled rows, give conjunctive rules (the conditions on the
path to each node); lasso logistic regression gives most rules no weight; the rest become one Spark
column expression, so scoring is a projection of the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import labelled_sample, text_of

#: Labelled rows the trees and weights are fitted on at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions, all 0 for an empty one.

    Every pattern takes linear time: it begins only where a word does, or looks at a fixed number of characters,
    and never gives back what it has matched.
    """
    words = F.greatest(F.regexp_count(text, F.lit(r"\S++")), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.array_remove(F.split(text, "\n"), "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    share = lambda pattern, of: F.regexp_count(text, F.lit(pattern)) / of
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "chars_per_word": F.length(text) / words,
        "capital_share": share(r"\p{Lu}", chars),
        # words with two capitals in a row and no small letter
        "capital_words": share(r"(?<!\S)(?:(?!\p{Lu}{2})[^\p{Ll}\s])*+\p{Lu}{2}[^\p{Ll}\s]*+(?!\S)", words),
        "digit_share": share(r"\d", chars),
        "symbol_share": share(r"[^\p{L}\p{N}\s.,;:'\"()?!-]", chars),
        # words that end in a symbol twice
        "symbol_runs": share(r"([^\p{L}\p{N}\s])\1(?!\S)", words),
        "alone_symbols": share(r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)", words),
        "exclaims": share("!", words),
        "stops": share(r"[.?](?=\s|$)", words),
        "repeated_words": share(r"(?<!\S)(\S++)\s(?=\1(?!\S))", words),
        "line_repeats": F.lit(1.0) - F.greatest(F.size(F.array_distinct(lines)), F.lit(1)) / n_lines,
        "words_per_line": words / n_lines,
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold); a statistic equal to the threshold isn't above it."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for k, (name, above, at) in enumerate(self.terms):
            term = F.col(name) > at if above else F.col(name) <= at
            out = out & term if k else term
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[n] > t if above else x[n] <= t for n, above, t in self.terms])


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, cuts: list[np.ndarray], path: tuple, out: list[tuple]) -> None:
    """Greedy splits by Newton gain over the candidate thresholds; out gets the path of every node."""
    total = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for j, thresholds in enumerate(cuts):
            if not len(thresholds):
                continue
            place = np.searchsorted(thresholds, x[rows, j], side="left")  # place k: above thresholds[:k]
            g = np.cumsum(np.bincount(place, gradient[rows], len(thresholds) + 1))[:-1]
            h = np.cumsum(np.bincount(place, hessian[rows], len(thresholds) + 1))[:-1]
            n = np.cumsum(np.bincount(place, minlength=len(thresholds) + 1))[:-1]
            gain = g**2 / (h + 1) + (total[0] - g) ** 2 / (total[1] - h + 1) - total[0] ** 2 / (total[1] + 1)
            gain[(n < 5) | (n > len(rows) - 5)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, float(thresholds[k]))
    if best[1] is None:
        return
    _, j, at = best
    above = x[rows, j] > at
    for side in (False, True):
        term = (*path, (j, side, at))
        out.append(term)
        _tree(x, gradient, hessian, rows[above == side], depth - 1, cuts, term, out)


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    rng, cuts = np.random.default_rng(seed), [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))) for c in x.T]
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        paths: list[tuple] = []
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        _tree(x, p - y, p * (1 - p), rows, depth, cuts, (), paths)
        for path in paths:
            found.setdefault(Rule(tuple((names[j], s, t) for j, s, t in path)))
        for path in [q for q in paths if not any(o[: len(q)] == q and len(o) > len(q) for o in paths)]:
            inside = np.logical_and.reduce([(x[:, j] > t) == s for j, s, t in path])
            g, h = (p - y)[inside].sum(), (p * (1 - p))[inside].sum()
            score[inside] -= rate * g / (h + 1)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient."""
    n = len(y)
    ones = np.concatenate([np.ones((n, 1)), z], axis=1)
    step = 4 * n / max(1e-9, np.linalg.norm(ones, 2) ** 2)
    w = v = np.zeros(ones.shape[1])
    t = 1.0
    for _ in range(rounds):
        u = v - step * (ones.T @ (1 / (1 + np.exp(-np.clip(ones @ v, -30, 30))) - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(0, np.abs(u[1:]) - step * penalty)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, v, t = u, u + (t - 1) / after * (u - w), after
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        terms = [F.lit(self.intercept), *(F.when(rule.column(), F.lit(weight)).otherwise(0.0) for rule, weight in self.rules)]
        while len(terms) > 1:  # pairwise, so that the expression isn't deep
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
        return 1 / (1 + F.exp(-terms[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, penalty: float = 0.002) -> RuleEnsemble:
    """Fits on at most sample_rows documents of docs (doc_id, text) that labels (doc_id, 0/1) marks, spread by a hash of
    doc_id; of rows of one doc_id one counts.

    Only statistics go to the driver, one row of a dozen numbers each. Rows without a label don't count;
    if all have one label, or there are none, the ensemble is that share alone without rules.
    """
    stats = statistics(text_of())
    rows = labelled_sample(docs, labels, label, sample_rows, [c.cast("double").alias(n) for n, c in stats.items()])
    rows = rows.toPandas().sort_values(["doc_id", "label", *stats])
    y, names = rows["label"].to_numpy().astype(float), list(stats)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return RuleEnsemble(math.log(share / (1 - share)), ())
    x = rows[names].to_numpy()
    rules = extract_rules(x, y, names)
    by_name = dict(zip(names, x.T))
    z = np.stack([r.holds(by_name) for r in rules], axis=1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows are one
    keep = [i for i in sorted(first) if 0 < z[:, i].sum() < len(y)]
    spread = z[:, keep].std(axis=0)
    intercept, weights = lasso_logistic(z[:, keep] / spread, y, penalty)
    return RuleEnsemble(intercept, tuple((rules[i], float(w / s)) for i, w, s in zip(keep, weights, spread) if abs(w) > 1e-6))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with score (0 to 1, the probability of label 1) and predicted (1 if score >= 0.5, else 0).

    A null text counts as empty; all columns and rows stay as they are, whatever the columns' names (but for
    score and predicted, which are replaced). No shuffle, no Python.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *(c.cast("double").alias(n) for n, c in statistics(text_of()).items()))
    scored = inner.select("_row", model.column().alias("score"))
    return scored.select("_row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

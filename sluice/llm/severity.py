"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade <= k) = logistic(theta_k - w.x) with ordered thresholds theta and one weight vector for all of
them. Features are words and beginnings of words (so that forms of one stem count together), each with
log(1 + occurrences in the whole text); most get no weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sluice.llm.common import labelled_sample, python_ready, text_of, written

#: Labelled rows that the model is fitted on at most, half of them toxic; features the driver counts in them at most;
#: and features with a weight at most.
SAMPLE_ROWS, TELLING, FEATURES = 4000, 4000, 300
PREFIXES = (4, 5, 6)
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def occurrences(text: str) -> Counter:
    """Words, and w + "*" for their beginnings w."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in PREFIXES:
            if len(word) >= k:
                out[word[:k] + "*"] += n
    return out


@dataclass(frozen=True)
class Severity:
    """theta: GRADES ordered thresholds; weights: of the features; cut: a document of a higher expected severity is toxic."""

    theta: tuple[float, ...]
    weights: dict[str, float]
    cut: float = 0.5

    def grade_probabilities(self, value: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(np.asarray(self.theta)[None, :] - value[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(value), 1)), below, np.ones((len(value), 1))], axis=1), axis=1)

    def values(self, texts: list[str]) -> np.ndarray:
        words = {f: w for f, w in self.weights.items() if f[-1] != "*"}
        stems = {f[:-1]: w for f, w in self.weights.items() if f[-1] == "*"}
        lengths = sorted({len(s) for s in stems})
        heads = {s[:k] for s in [*words, *stems] for k in [min(3, len(s))]}
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: Counter = Counter()
            for word in _WORD.findall(text.lower()):
                if word[:3] not in heads:
                    continue
                if word in words:
                    found[word] += 1
                for k in lengths:
                    if len(word) >= k and word[:k] in stems:
                        found[word[:k] + "*"] += 1
            out[i] = sum(self.weights[f] * np.log1p(n) for f, n in sorted(found.items()))
        return out


def fit_cumulative(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 0.002, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """theta (grades,) and weights by proximal gradient steps on the likelihood; grade in 0..grades."""
    n, m = x.shape
    w, theta = np.zeros(m), np.linspace(1, 2, grades)
    moment_w, moment_t, second_w, second_t = np.zeros(m), np.zeros(grades), np.zeros(m), np.zeros(grades)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        bounds = np.concatenate([[-40.0], theta, [40.0]])
        value = x @ w
        high = 1 / (1 + np.exp(-np.clip(bounds[grade + 1] - value, -40, 40)))
        low = 1 / (1 + np.exp(-np.clip(bounds[grade] - value, -40, 40)))
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        grad_w = x.T @ ((d_high - d_low) / p) / n + 1e-4 * w
        grad_t = np.zeros(grades + 2)
        np.add.at(grad_t, grade[rows] + 1, -d_high / p / n)
        np.add.at(grad_t, grade[rows], d_low / p / n)
        grad_t = grad_t[1:-1]
        rate = 0.05 / np.sqrt(1 + step / 300)
        for value_, grad, moment, second in ((w, grad_w, moment_w, second_w), (theta, grad_t, moment_t, second_t)):
            moment *= 0.9
            moment += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad**2
            value_ -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-3)
        w[:] = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty)
        theta[:] = np.maximum.accumulate(theta + 1e-3 * np.arange(grades))
    return theta, w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Severity:
    """Fits on at most sample_rows documents of docs (doc_id, text) that labels (doc_id, 0/1) marks, half of each label, by a hash of doc_id.

    Labels have no grades, so toxic rows get 1..GRADES by thirds of how often features of the toxic stand in
    them. Without rows of both labels nothing is toxic. No text goes to the driver: features are counted where
    the texts are, and what is gathered are TELLING features at most and their counts in the sampled rows.
    """
    python_ready(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, label, sample_rows, [text_of().alias("text")], by_label=True), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Severity(tuple(40.0 + k for k in range(GRADES)), {})
    counts, y = _counted(sample, _telling(sample, n0, n1))
    chosen = _choose([set(c) for c in counts], y, features)
    at = {f: j for j, f in enumerate(chosen)}
    x = np.zeros((len(counts), len(chosen)))
    for i, c in enumerate(counts):
        for f, n in c.items():
            if f in at:
                x[i, at[f]] = np.log1p(n)
    total = x.sum(axis=1)
    edges = np.quantile(total[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(edges, total, side="left"), 0)
    theta, w = fit_cumulative(x, grade, GRADES)
    model = Severity(tuple(theta.tolist()), {f: float(w[j]) for f, j in at.items() if abs(w[j]) > 0.05})
    expected = model.grade_probabilities(x @ np.where(np.abs(w) > 0.05, w, 0)) @ np.arange(GRADES + 1)
    cuts = np.linspace(0.1, 1.5, 57)
    errors = [(((expected > c) != (y == 1)).sum(), abs(c - 0.5)) for c in cuts]
    return Severity(model.theta, model.weights, float(cuts[min(range(len(cuts)), key=lambda i: errors[i])]))


def _telling(sample: DataFrame, n0: int, n1: int) -> set[str]:
    """Features of enough toxic rows, and four times as frequent there; of more than TELLING those of most toxic rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                found = list(occurrences(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int64())], names=["feature", "label"])

    found = sample.mapInArrow(each, "feature string, label long").groupBy("feature").agg(F.sum("label").alias("df1"), F.sum(1 - F.col("label")).alias("df0"))
    enough = found.where((F.col("df1") >= max(3, n1 // 200)) & (F.col("df1") / n1 > 4 * (F.col("df0") + 0.5) / n0))
    return {r["feature"] for r in enough.orderBy(F.col("df1").desc(), "feature").limit(TELLING).collect()}


def _counted(sample: DataFrame, telling: set[str]) -> tuple[list[dict[str, int]], np.ndarray]:
    """For each row, in order of label and doc_id, how often each telling feature stands in it; and the labels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{f: n for f, n in occurrences(t).items() if f in telling} for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["label"], pa.array([list(r) for r in rows], pa.list_(pa.string())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "features", "times"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(each, "doc_id long, label int, features array<string>, times array<long>").collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    return [dict(zip(r["features"], r["times"])) for r in rows], np.array([r["label"] for r in rows], dtype=int)


def _choose(sets: list[set], y: np.ndarray, most: int) -> list[str]:
    """Features one by one: the best log-odds evidence over rows that no earlier one explains, so that what
    merely stands beside a chosen feature isn't chosen; a stem before its longer forms."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    df0: Counter = Counter()
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        if y[i]:
            for f in s:
                where.setdefault(f, []).append(i)
        else:
            df0.update(s)
    chosen: list[str] = []
    seen = np.zeros(len(sets), dtype=int)
    while where and len(chosen) < most:
        gain = {f: sum(0.5 ** seen[i] for i in ids) * np.log((len(ids) / n1) / ((df0[f] + 0.5) / n0)) for f, ids in where.items()}
        best = max(gain, key=lambda f: (gain[f], -len(f), f))
        ids = where.pop(best)
        if gain[best] < 3 or (fresh := sum(seen[i] == 0 for i in ids)) == 0 and len(chosen) >= 40:
            break
        chosen.append(best)
        seen[ids] += 1
        where = {f: v for f, v in where.items() if gain[f] >= 1}
    return chosen


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """docs with severity (expected grade, 0 to GRADES), grade (the likeliest), score (severity as a share of
    the highest grade) and predicted (1 toxic, 0 not).

    A null text is empty and so not toxic; all rows and columns stay (columns of these four names are
    replaced). The model, of a bounded number of features, goes along with the task; no shuffle.
    """
    python_ready(docs.sparkSession)
    added = ("severity", "grade", "score", "predicted")
    kept = [c for c in docs.columns if c.lower() not in added]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = [c.lower() for c in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.grade_probabilities(model.values(batch.column(at).fill_null("").to_pylist()))
            expected = p @ np.arange(p.shape[1])
            columns = [pa.array(expected), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(expected / (p.shape[1] - 1)), pa.array((expected > model.cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = StructType([*frame.schema.fields, *(StructField(c, t()) for c, t in zip(added, (DoubleType, IntegerType, DoubleType, IntegerType)))])
    return frame.mapInArrow(run, schema)

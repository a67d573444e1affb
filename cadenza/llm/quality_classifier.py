"""A sparse rule ensemble for document quality.

Statistics of the text are computed by DataFrame functions. Small boosted trees are grown on a bounded
sample of labelled rows; each path from a root to a node is a rule, a conjunction of bounds on statistics.
A logistic model with an L1 penalty keeps few of the rules, and those are compiled into one Spark column
expression, so that scoring the corpus needs no Python.

Defined results: null and empty texts have all statistics 0 and are scored like any other; without labels
of both classes the score is the share of label 1 (0.5 where there are none); labels that are null are not
used, repeated labels count repeatedly; repeated documents are scored one by one; other columns are ignored;
texts of any length are measured whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, words_of
from cadenza.llm.quality_rules import measure

#: Labelled rows that the model is fitted on at most; the first in the order of a hash.
SAMPLE = 20_000
TREES, DEPTH, BINS = 24, 3, 24
#: Rows that a node of a tree needs.
LEAST = 8
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)
THRESHOLD = 0.3
#: Statistics in terms of the measurements and counts below.
STATISTICS = {
    "words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "ln(1 + n_words / greatest(n_lines, 1))",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "distinct_root": "n_distinct / sqrt(greatest(n_words, 1))",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "short": "n_short / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the STATISTICS, as doubles."""
    words = F.col("_words")
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("_words", words_of(F.col("text")))
    extra = src.select(
        F.struct(
            F.col("doc_id"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
            F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
            F.regexp_count("text", F.lit(r"\p{Nd}")).alias("n_digits"),
            F.regexp_count("text", F.lit(r"\.(?=[\x20\x09-\x0D]|$)")).alias("n_stops"),
            F.size(F.filter(words, lambda w: F.length(w) <= 3)).alias("n_short"),
        ).alias("doc_id"),
        "text",
    )
    # the counts ride along in the id through the measurements, which are made once
    both = measure(extra).select("doc_id.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return both.select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


@dataclass(frozen=True)
class Rule:
    """`bounds`: (statistic, low, high) with low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (F.col(name) > F.lit(low))
            if high < math.inf:
                out = out & (F.col(name) <= F.lit(high))
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        z = F.lit(self.intercept)
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[dict[int, tuple[int, int]]], np.ndarray]:
    """A regression tree on binned statistics: the paths to all its nodes, as statistic -> bins (low, high],
    and its value for each row."""
    paths: list[dict[int, tuple[int, int]]] = []
    values = np.zeros(len(bins))

    def split(rows: np.ndarray, path: dict[int, tuple[int, int]], depth: int) -> None:
        if path:
            paths.append(path)
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, x, BINS)) for x in (g, h, np.ones(len(rows))))
                ok = (ns[:-1] >= LEAST) & (ns[-1] - ns[:-1] >= LEAST)
                gain = np.where(ok, gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
        if best[1] < 0:
            values[rows] = g.sum() / (h.sum() + 1)
            return
        _, f, at = best
        low, high = path.get(f, (-1, BINS))
        left = bins[rows, f] <= at
        split(rows[left], path | {f: (low, min(high, at))}, depth + 1)
        split(rows[~left], path | {f: (max(low, at), high)}, depth + 1)

    split(np.arange(len(bins)), {}, 0)
    return paths, values


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the first column is free."""
    w, v, t = start.copy(), start.copy(), 1.0
    step = 4 * len(y) / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    for _ in range(steps):
        new = v - step * (x.T @ (_sigmoid(x @ v) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """The rule ensemble of labelled statistics (rows in a fixed order: the result is the same each time)."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Ensemble(math.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = _sigmoid(z)
        grown, values = _grow(bins, y - p, p * (1 - p))
        paths.update({tuple(sorted(path.items())): None for path in grown})
        z = z + 0.3 * np.clip(values, -4, 4)
    rules, columns, seen = [], [], set()
    for path in paths:
        on = np.ones(len(y), bool)
        for f, (low, high) in path:
            on &= (bins[:, f] > low) & (bins[:, f] <= high)
        if 0 < on.sum() < len(y) and (key := on.tobytes()) not in seen:
            seen.add(key)
            rules.append(path)
            columns.append(on)
    m = np.column_stack([np.ones(len(y)), *columns]).astype(float)
    # the penalty with the best log loss on every fourth row
    check = np.arange(len(y)) % 4 == 3
    best, w = (math.inf, PENALTIES[0]), np.zeros(m.shape[1])
    for penalty in PENALTIES if check.any() and len(set(y[~check])) == 2 else ():
        w = _lasso(m[~check], y[~check], penalty, w)
        p = np.clip(_sigmoid(m[check] @ w), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)))
        best = min(best, (loss, penalty))
    w = np.zeros(m.shape[1])
    for penalty in PENALTIES:
        w = _lasso(m, y, penalty, w)
        if penalty <= best[1]:
            break
    out = Ensemble(float(w[0]))
    for path, weight in zip(rules, w[1:], strict=True):
        if abs(weight) > 1e-4:
            bounds = []
            for f, (low, high) in path:
                e = edges[f]
                bounds.append((names[f], float(e[low]) if low >= 0 else -math.inf, float(e[high]) if high < len(e) else math.inf))
            out.rules.append(Rule(tuple(bounds), float(weight)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Fit on at most `sample` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = statistics(texts).join(chosen, "doc_id").orderBy("doc_id", "label", *STATISTICS).collect()
    names = list(STATISTICS)
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return fit(x, np.array([r["label"] for r in rows], float), names)


def classify(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

"""Operator 10: a quality classifier made of rules.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root becomes a
conjunctive rule over text statistics; a lasso logistic fit keeps few of them; and the kept rules are
compiled into one Spark column expression, so scoring is a projection over the statistics.

Sample bound: ``MAX_TRAIN`` labelled rows, those with the smallest hash of doc_id. Rows whose
crc32(doc_id as text) mod 5 is 0 are never learned from.

Defined cases: a null or empty text is scored like any other (its statistics are 0); without labels, or
with one class only, the score is the smoothed share of label 1; several labels of one doc_id count as
the largest; repeated rows are scored each; only doc_id and text of the input are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stats import STATS_TYPE, with_stats

MAX_TRAIN = 12_000
TREES, DEPTH, LEAST, RATE = 24, 3, 20, 0.3
PENALTY, STEPS = 2e-4, 400
THRESHOLD = 0.3
#: Inputs of the rules: expressions over the statistics.
FEATURES: dict[str, str] = {
    "words": "ln(1.0D + n_words)",
    "word_length": "word_chars / greatest(n_words, 1.0D)",
    "symbols": "n_symbols / greatest(n_words, 1.0D)",
    "upper": "n_upper_words / greatest(n_words, 1.0D)",
    "exclaimed": "n_exclaimed / greatest(n_words, 1.0D)",
    "stops": "n_stops / greatest(n_words, 1.0D)",
    "digits": "n_digits / greatest(n_chars, 1.0D)",
    "repeated": "n_repeat_words / greatest(n_words, 1.0D)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1.0D)",
    "distinct": "n_distinct_words / greatest(n_words, 1.0D)",
    "line_words": "n_words / greatest(n_lines, 1.0D)",
}
Rule = tuple[tuple[int, bool, float], ...]  # feature, above, threshold


@dataclass
class RuleModel:
    """Conjunctive rules with weights, and an intercept."""

    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def column(self, feature) -> Column:
        """The score as a column; ``feature(i)`` is the column of feature i."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for i, above, threshold in rule:
                test = (feature(i) > F.lit(threshold)) if above else (feature(i) <= F.lit(threshold))
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """Rules of all paths of one tree, and the tree's value for every row."""
    rules, value = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value[rows] = g / (h + 1)
        if path:
            rules.append(path)
        if depth == DEPTH or len(rows) < 2 * LEAST:
            return
        best = (1e-6, 0, 0.0)
        for i, own in enumerate(cuts):
            k = np.searchsorted(own, x[rows, i], "left")
            n = np.bincount(k, minlength=len(own) + 1).cumsum()[:-1]
            gl = np.bincount(k, gradient[rows], len(own) + 1).cumsum()[:-1]
            hl = np.bincount(k, hessian[rows], len(own) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), i, float(own[int(gain.argmax())]))
        gain, i, cut = best
        if gain > 1e-6:
            left = x[rows, i] <= cut
            grow(rows[left], (*path, (i, False, cut)), depth + 1)
            grow(rows[~left], (*path, (i, True, cut)), depth + 1)

    grow(np.arange(len(x)), (), 0)
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, threshold in rule:
        out &= (x[:, i] > threshold) == above
    return out


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, their paths as rules, and a lasso logistic fit over the rules."""
    share = (y.sum() + 1) / (len(y) + 2)
    flat = RuleModel([], np.zeros(0), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return flat
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 49))) for i in range(x.shape[1])]
    margin, rules = np.full(len(y), flat.intercept), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, value = _tree(x, y - p, np.maximum(p * (1 - p), 1e-6), cuts)
        rules += found
        margin = margin + RATE * value
    rules = list(dict.fromkeys(rules))
    matrix, kept, seen = [], [], set()
    for rule in rules:
        column = holds(rule, x)
        if 0 < column.sum() < len(y) and (key := column.tobytes()) not in seen:
            seen.add(key)
            matrix.append(column)
            kept.append(rule)
    if not kept:
        return flat
    a = np.array(matrix, np.float32).T
    mean = a.mean(0)
    a -= mean
    w, b, z, zb, t = np.zeros(a.shape[1]), flat.intercept, np.zeros(a.shape[1]), flat.intercept, 1.0
    step = 4 / max(1e-9, (np.linalg.norm(a, 2) ** 2 / len(y)) + 1)
    for _ in range(STEPS):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(a @ z + zb)))
        w_next = z - step * (a.T @ (p - y) / len(y))
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - step * PENALTY, 0)
        b_next = zb - step * float((p - y).mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    on = np.flatnonzero(w)
    return RuleModel([kept[i] for i in on], w[on], float(b - (mean[on] * w[on]).sum()))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> RuleModel:
    """Fit on at most ``most`` labelled documents; only their texts are read, by a broadcast of their ids (bounded by ``most``).

    Of rows that share a doc_id the least text stands for it, so the sample is the same in every run.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = with_stats(rows, "stats").select("label", *(F.expr(_over(e, "stats")).alias(n) for n, e in FEATURES.items())).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float))


def _over(expression: str, struct: str) -> str:
    import re

    names = "|".join(STATS_TYPE.fieldNames())
    return re.sub(rf"\b({names})\b", rf"`{struct}`.\1", expression)


def scored(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """``docs`` with the model's score of each text; all its columns stay."""
    taken = set(docs.columns)
    stats = next(n for n in (f"_stats{k or ''}" for k in range(len(taken) + 1)) if n not in taken)
    out = with_stats(docs, stats)
    features = F.array(*(F.expr(_over(e, stats)) for e in FEATURES.values()))
    wide = out.withColumn(f"{stats}f", features)
    return wide.withColumn(score, model.column(lambda i: F.col(f"{stats}f")[i])).drop(stats, f"{stats}f")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

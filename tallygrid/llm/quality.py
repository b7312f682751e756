"""Document quality by a sparse rule ensemble.

Statistics of a text are Spark column expressions. On a bounded sample of labelled rows boosted
trees are grown over them; every path from a root to a node is a rule, a conjunction of
comparisons. Lasso logistic regression picks few rules and their weights. The ensemble is compiled
back into one column expression, so scoring stays inside Spark.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import WHITE, bounded_sample, fold, held_out, logit, sigmoid, table

CUT = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # statistic, whether it lies above, limit


def _share(of: Column, whole: Column) -> Column:
    return F.when(whole > 0, of / whole).otherwise(0.0)


def _parts(text: str) -> dict[str, Column]:
    """What the statistics are made of; every entry is needed once or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    return {
        "_chars": F.length(t), "_words": words, "_lines": F.split(t, "\n"),
        "_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "_symbols": F.regexp_count(t, F.lit(r"[#$%&*|@=+<>~^_\\/{}\[\]]")),
        "_marks": F.regexp_count(t, F.lit(r"[!?]")),
        "_stops": F.regexp_count(t, F.lit(r"[.,;:]")),
        "_digits": F.regexp_count(t, F.lit(r"[0-9]")),
    }


def _statistics() -> dict[str, Column]:
    chars, words, lines = F.col("_chars"), F.size("_words"), F.size("_lines")
    return {
        "chars": F.log1p(chars), "words": F.log1p(words), "word_length": _share(chars - words, words),
        "words_a_line": F.log1p(_share(words, lines)), "lines": F.log1p(lines),
        "capitals": _share(F.col("_capitals"), chars), "symbols": _share(F.col("_symbols"), chars),
        "marks": _share(F.col("_marks"), chars), "stops": _share(F.col("_stops"), words),
        "digits": _share(F.col("_digits"), chars),
        "different_words": _share(F.size(F.array_distinct("_words")), words),
        "different_lines": _share(F.size(F.array_distinct("_lines")), lines),
    }


STATISTICS = [
    "chars", "words", "word_length", "words_a_line", "lines", "capitals", "symbols", "marks", "stops",
    "digits", "different_words", "different_lines",
]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and a column for each statistic of the whole text; null is empty."""
    parts = docs.select(*keep, *[c.alias(name) for name, c in _parts(text).items()])
    return parts.select(*keep, *[c.cast("double").alias(name) for name, c in _statistics().items()])


@dataclass
class Ensemble:
    """Weighted rules; the score is the logistic function of their sum and the bias."""

    bias: float
    rules: list[tuple[Rule, float]]


def _grow(x, gradient, depth: int, least: int, path: Rule, out: list[Rule], names, rows, leaf) -> None:
    """Split the rows by the best of all limits; notes the path of every node."""
    if path:
        out.append(path)
    best = None
    if depth and len(rows) >= 2 * least:
        g = gradient[rows]
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            values, sums = x[rows, f][order], np.cumsum(g[order])
            n = np.arange(1, len(rows) + 1)
            gain = sums**2 / n + (sums[-1] - sums) ** 2 / np.maximum(len(rows) - n, 1)
            allowed = (n >= least) & (len(rows) - n >= least)
            allowed[:-1] &= values[1:] > values[:-1]
            allowed[-1] = False
            if allowed.any():
                k = int(np.argmax(np.where(allowed, gain, -np.inf)))
                if best is None or gain[k] > best[0]:
                    best = gain[k], f, float((values[k] + values[k + 1]) / 2)
    if best is None or best[0] <= gradient[rows].sum() ** 2 / len(rows) + 1e-9:
        leaf[rows] = gradient[rows].mean()
        return
    _, f, limit = best
    above = x[rows, f] > limit
    for side in (False, True):
        _grow(x, gradient, depth - 1, least, (*path, (names[f], side, limit)), out, names, rows[above == side], leaf)


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.all([(x[:, names.index(f)] > limit) == above for f, above, limit in rule], axis=0)


def lasso_logistic(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400):
    """Bias and weights by accelerated proximal gradients; the bias is not penalised."""
    centre = r.mean(0)
    z = np.concatenate([np.ones((len(r), 1)), r - centre], 1)
    step = 4.0 / max(np.linalg.norm(z * np.sqrt(weight / weight.sum())[:, None], 2) ** 2, 1e-9)
    w = look = np.zeros(z.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        moved = look - step * z.T @ ((sigmoid(z @ look) - y) * weight / weight.sum())
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = moved + (momentum - 1) / following * (moved - w)
        w, momentum = moved, following
    return float(w[0] - w[1:] @ centre), w[1:]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: list[str] = STATISTICS,
          trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5) -> Ensemble:
    """Rules from boosted trees and their lasso weights."""
    if not len(y) or y.min() == y.max():
        return Ensemble(float(logit((y.sum() + 1) / (len(y) + 2))), [])
    rng, score, paths = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(trees):
        part = rng.permutation(len(y))[: max(40, len(y) // 2)]
        leaf = np.zeros(len(y))
        grown: list[Rule] = []
        gradient = (y - sigmoid(score)) * weight
        _grow(x, gradient, depth, max(5, len(y) // 200), (), grown, names, np.sort(part), leaf)
        paths += grown
        for rule in grown:  # leaves give the step of every row, also of those left out
            inside = _holds(rule, x, names)
            if inside.any() and inside[part].any():
                leaf[inside] = gradient[part][inside[part]].mean()
        score += rate * 4 * leaf
    seen, columns = {}, []
    for rule in paths:
        held = _holds(rule, x, names)
        key = np.packbits(held).tobytes()
        if 0 < held.sum() < len(held) and key not in seen and np.packbits(~held).tobytes() not in seen:
            seen[key] = rule
            columns.append(held)
    if not columns:
        return Ensemble(float(logit(np.average(y, weights=weight))), [])
    bias, w = lasso_logistic(np.stack(columns, 1).astype(np.float64), y, weight, penalty)
    kept = [(rule, float(v)) for rule, v in zip(seen.values(), w, strict=True) if abs(v) > 1e-3]
    return Ensemble(bias, kept)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Ensemble:
    """Ensemble learnt from at most ``per_class`` labelled texts of each class.

    ``labels`` has ``doc_id`` and ``quality``. Rows with a null id, text or label teach nothing.
    Rows count by the share of their class among all labels, so scores are probabilities. Of several
    rows with one id one is taken. Statistics are those of the whole texts; only they reach the driver.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    rows, y, weight, order = [], [], [], []
    for value in sorted(sizes):
        keys = usable.where(F.col("quality") == value).select("doc_id").distinct()
        sample = bounded_sample(docs, keys, ["text"], per_class)
        found = with_statistics(sample, ["doc_id"]).collect()
        rows += [[r[s] for s in STATISTICS] for r in found]
        order += [(zlib.crc32(str(r.doc_id).encode()), r.doc_id) for r in found]
        y += [value] * len(found)
        weight += [sizes[value] / max(len(found), 1)] * len(found)
    at = sorted(range(len(rows)), key=lambda k: (order[k], rows[k]))
    w = np.array(weight, np.float64)[at]
    return train(np.array(rows, np.float64)[at].reshape(-1, len(STATISTICS)), np.array(y, np.float64)[at],
                 w / w.mean() if len(w) else w)


def compiled(model: Ensemble) -> Column:
    """The score over columns named like the statistics."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        holds = [F.col(f) > limit if above else F.col(f) <= limit for f, above, limit in rule]
        total = total + F.when(reduce(Column.__and__, holds), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_documents(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row.

    Null and empty texts have statistics of 0. Repeated rows are scored each, null ids stay null,
    other columns of ``docs`` are not read and an empty table gives none.
    """
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", compiled(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


FOLDS, HELD_OUT = 5, 0


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return score_documents(docs, model).withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD_OUT))

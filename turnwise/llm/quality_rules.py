"""Quality by a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on labelled rows; every path from a root to a node is a conjunctive rule.
A lasso logistic regression weighs the rules and drops most of them; what is left is compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnwise.llm._spark import give_back, kept, only, small_batches
from turnwise.llm._text import buffers, slices, word_hashes

STATISTICS = (
    "words", "word_bytes", "upper", "letters", "digits", "spaces", "lines", "line_words", "marks", "exclamations", "pipes", "symbols",
    "wide", "distinct_words", "distinct_lines", "top_word", "long_words", "short_words", "stop_gap", "capital_words", "sentence_ends", "repeat_5",
)
#: Labelled rows that the fit takes at most (those with the least hash of the id), trees, their depth, rounds of the lasso.
TRAIN_ROWS, TREES, DEPTH, PENALTY = 20_000, 24, 3, 0.002


def text_statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text: shares of its bytes or words, and logarithms of counts. Of the whole text."""
    data, offsets = buffers(column)
    parts = [np.zeros((0, len(STATISTICS)), np.float64)]
    for low, high in slices(offsets):
        part = data[offsets[low] : offsets[high]]
        words, bounds, starts, ends = word_hashes(part, offsets[low : high + 1] - offsets[low], ends=True)
        out = np.zeros((high - low, len(STATISTICS)))
        widths = ends - starts
        for i in range(high - low):
            raw = part[offsets[low + i] - offsets[low] : offsets[low + i + 1] - offsets[low]]
            w, n = words[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i])
            if not n:
                continue
            size, length = len(raw), widths[bounds[i] : bounds[i + 1]]
            b = np.bincount(raw, minlength=256)
            first, last = part[starts[bounds[i] : bounds[i + 1]]], part[ends[bounds[i] : bounds[i + 1]] - 1]
            lines = [x for x in raw.tobytes().split(b"\n") if x.strip()]
            counts = np.unique(w, return_counts=True)[1]
            pairs = w[4:] * np.uint64(3) + w[:-4] if n > 4 else w
            upper, letters = b[65:91].sum(), b[65:91].sum() + b[97:123].sum() + b[128:].sum()
            symbols = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
            marks = b[ord(".")] + b[ord(",")]
            out[i] = (
                np.log1p(n), length.mean(), upper / size, letters / size, b[48:58].sum() / size, b[32] / size, len(lines) / n, np.log1p(n / max(1, len(lines))), marks / n, b[33] / n, b[124] / n,
                (symbols - marks - b[33] - b[124]) / n, b[128:].sum() / size, len(counts) / n, len(set(lines)) / max(1, len(lines)), counts.max() / n, (length > 12).mean(), (length < 4).mean(),
                np.sort(counts)[-5:].sum() / n, ((first >= 65) & (first <= 90)).mean(), np.isin(last, [46, 33, 63]).mean(), 1 - len(np.unique(pairs)) / max(1, len(pairs)),
            )
        parts.append(out)
    return np.vstack(parts)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether it must be above, bound)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, bound in self.terms:
            out &= (x[:, k] > bound) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, bound in self.terms:
            c = F.col(STATISTICS[k]) > F.lit(float(bound))
            out = out & (c if above else ~c)
        return out


def grow(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int, bins: list[np.ndarray], codes: np.ndarray, smooth: float = 1.0) -> list[tuple[Rule, float]]:
    """Paths to all nodes of a tree of second-order gains, with the leaves' steps."""
    paths: list[tuple[Rule, float]] = []

    def split(at: np.ndarray, terms: tuple, left: int) -> None:
        g, h = gradient[at].sum(), curve[at].sum()
        best = (1e-6, 0, 0)
        if left and len(at) >= 20:
            for k in range(x.shape[1]):
                size = len(bins[k]) + 1
                if size < 2:
                    continue
                c = codes[at, k]
                gs, hs = np.cumsum(np.bincount(c, gradient[at], size))[:-1], np.cumsum(np.bincount(c, curve[at], size))[:-1]
                n = np.cumsum(np.bincount(c, minlength=size))[:-1]
                gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
                gain[(n < 5) | (len(at) - n < 5)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), k, int(gain.argmax()))
        if terms:
            paths.append((Rule(terms), -g / (h + smooth) if best[0] <= 1e-6 else 0.0))
        if best[0] > 1e-6:
            _, k, cut = best
            above = codes[at, k] > cut
            split(at[~above], (*terms, (k, False, float(bins[k][cut]))), left - 1)
            split(at[above], (*terms, (k, True, float(bins[k][cut]))), left - 1)

    split(np.arange(len(x)), (), depth)
    return paths


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n, k = z.shape
    step = 4.0 / max(1e-9, np.linalg.eigvalsh(z.T @ z / n)[-1] + 1.0) if k else 1.0
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - step * (z.T @ error / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        intercept = c - step * error.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / u * (new - w), intercept + (t - 1) / u * (intercept - b)
        w, b, t = new, intercept, u
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The score, as an expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """One class alone gives its (smoothed) share as every score."""
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max():
        return RuleEnsemble((), (), float(np.log(base / (1 - base))))
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 48))) for k in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bins)])
    margin, rules = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rule, value in grow(x, p - y, p * (1 - p), depth, bins, codes):
            rules.setdefault(rule)
            if value:
                margin = margin + 0.3 * value * rule.holds(x)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float)
    usable = (z.mean(0) > 0) & (z.mean(0) < 1)
    names = [r for r, u in zip(rules, usable) if u]
    weights, intercept = lasso(z[:, usable], y.astype(float), penalty)
    at = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble(tuple(names[i] for i in at), tuple(float(weights[i]) for i in at), float(intercept))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType

    def run(batches):
        give_back()
        for batch in batches:
            x = text_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(x.T))], ["id", *STATISTICS])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {kind.simpleString()}", *(f"`{s}` double" for s in STATISTICS)]))


def majority(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): one label for each id; of repeated rows the more frequent, 1 on a tie; null labels don't count."""
    return labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))


def remainder(id_: Column, parts: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % parts


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
) -> DataFrame:
    """id_col, held_out, score and predicted of every row of docs; repeated rows give a row each.

    Labels are taken from rows of docs whose crc32(id) mod folds isn't 0 (held_out false), train_rows of them at most:
    a bounded sample by a hash of the id, which the driver fits. Scores depend on the text alone. Null and empty texts
    have statistics of 0 and a score like any other; a null id is held out. With labels of one class, or none, all
    scores are that class's smoothed share. Further columns, and labels without a document, are left out.
    """
    held = F.coalesce(remainder(F.col("id"), folds) == 0, F.lit(True))
    rows = kept(with_statistics(docs, id_col, text_col))
    train = rows.where(~held).join(majority(labels, id_col, label_col), "id").orderBy(F.xxhash64("id"), *STATISTICS[:4]).limit(train_rows)
    sample = train.select("label", *STATISTICS).toPandas()
    model = fit_rules(sample[list(STATISTICS)].to_numpy(float), sample["label"].to_numpy(int), trees, depth, penalty)
    scored = rows.withColumn("score", model.column())
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are predicted to be good: those whose id has a good text. Null ids stay."""
    with small_batches(docs.sparkSession):
        scores = quality_scores(docs, labels, id_col, text_col, **options)
    good = scores.where(F.col(id_col).isNotNull() & (F.col("predicted") == 1)).select(id_col).distinct()
    return only(docs, kept(good), id_col).select(docs.columns).union(docs.where(F.col(id_col).isNull()))

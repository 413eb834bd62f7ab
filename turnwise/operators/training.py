"""Multinomial logistic regression by summed gradients, all penalties and folds in one pass a step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.operators.ranking import stratified_folds
from turnwise.operators.storing import kept

#: fixed values: the inverse penalties that are tried, and the number of folds
PENALTIES, FOLDS = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0), 5
#: First stage of the sum of gradients: keys that the tasks' sums of a model are dealt to.
SALTS = 16


#: Rows of a block, in the order of their folds, as which a task keeps its rows; and scores (rows by models by classes) computed at once.
BLOCK, SCORES = 4_096, 1 << 20


def _rows(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d).astype(np.float64), batch.column("y").to_numpy(), batch.column("fold").fill_null(-1).to_numpy()


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax of x (rows, d) under weights (classes, d + 1), the last column of which is the intercept."""
    z = x @ weights[:, :-1].T + weights[:, -1]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the log losses of rows, and its gradient (classes, d + 1)."""
    p = probabilities(x, weights)
    at = np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
    p[at, y] -= 1
    return float(loss), np.concatenate([p.T @ x, p.sum(0)[:, None]], 1)


def losses_and_gradients(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """loss_and_gradient of several models at once: weights (models, classes, d + 1)."""
    m, classes, d = weights.shape
    losses, sums = np.zeros(m), np.zeros((m * classes, d))
    every, many = weights.reshape(m * classes, d).T, max(1, SCORES // max(1, m * classes))
    for low in range(0, len(y), many):
        own, one = y[low : low + many], np.ones((min(many, len(y) - low), 1))
        part = np.concatenate([x[low : low + many], one], 1)
        p = (part @ every).reshape(-1, m, classes)
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        at = np.arange(len(own))
        losses -= np.log(np.maximum(p[at, :, own], 1e-300)).sum(0)
        p[at, :, own] -= 1
        sums += p.reshape(-1, m * classes).T @ part
    return losses, sums.reshape(m, classes, d)


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """rows as blocks of bytes (x, y, fold), so that a step hands few rows to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold = _rows(batch, d)
            for low in range(0, len(y), BLOCK):
                order = low + np.argsort(fold[low : low + BLOCK], kind="stable")
                parts = (x[order], y[order].astype(np.int32), fold[order].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], ["x", "y", "fold"])

    return rows.mapInArrow(run, "x binary, y binary, fold binary")


def _by_fold(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, x, y) of the rows of blocks, those of a fold in a block together."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, fold = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.float64, np.int32, np.int32)))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(fold)) + 1, [len(fold)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield int(fold[a]), x.reshape(-1, d)[a:b], y[a:b]


def _summed(rows: DataFrame) -> DataFrame:
    """(model, loss, g): rows of tasks added up, a model's in two stages, so that no task has all of them."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(g.as_buffer()) for g in table.column("g").combine_chunks()], axis=0)
        return pa.table({"model": table.column("model")[:1], "salt": table.column("salt")[:1], "loss": pa.array([sum(table.column("loss").to_pylist())]), "g": pa.array([total.tobytes()], pa.binary())})

    shape = "model int, salt int, loss double, g binary"
    return rows.groupBy("model", "salt").applyInArrow(add, shape).withColumn("salt", F.lit(0)).groupBy("model", "salt").applyInArrow(add, shape)


class _Descent:
    """Limited-memory quasi-Newton steps of one model; ask gives the point to evaluate, tell takes its value and gradient."""

    def __init__(self, start: np.ndarray, memory: int = 12) -> None:
        self.x, self.f, self.g = start, np.inf, np.zeros_like(start)
        self.trial, self.memory, self.pairs, self.step, self.done = start, memory, [], 1.0, False

    def ask(self) -> np.ndarray:
        return self.trial

    def tell(self, f: float, g: np.ndarray, tolerance: float) -> None:
        if f <= self.f + 1e-4 * float(self.g @ (self.trial - self.x)) if np.isfinite(self.f) else True:
            if np.isfinite(self.f):
                s, y = self.trial - self.x, g - self.g
                if s @ y > 1e-12 * (y @ y):
                    self.pairs = [*self.pairs, (s, y)][-self.memory :]
            self.x, self.f, self.g = self.trial, f, g
            if np.abs(g).max() <= tolerance:
                self.done = True
                return
            q, past = g.copy(), []
            for s, y in reversed(self.pairs):
                a = (s @ q) / (s @ y)
                q -= a * y
                past.append(a)
            if self.pairs:
                s, y = self.pairs[-1]
                q *= (s @ y) / (y @ y)
            else:
                q /= max(1.0, np.abs(g).sum())
            for (s, y), a in zip(self.pairs, reversed(past)):
                q += (a - (y @ q) / (s @ y)) * s
            self.way, self.step = -q, 1.0
        else:
            self.step /= 2
            if self.step < 1e-10:
                self.done = True
                return
        self.trial = self.x + self.step * self.way


def fit(rows: DataFrame, penalties: Sequence[float], folds: int, classes: int, steps: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, scale): weights[c, k] (classes, d + 1) of inverse penalty c fitted without fold k (k = folds: on all rows), for
    features standardised by mean[k] and scale[k]; it minimises half the squared weights, intercepts left out, plus c times the loss.

    rows: x (array of numbers, of one length), y (class from 0), fold. Rows stay in their tasks: a step sends each task's gradients, one for
    each model, and brings back their sums; what the driver holds are the models.
    """
    plain = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    context = rows.sparkSession.sparkContext
    d = len(plain.first()["x"])
    data = kept(_blocks(plain, d))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((folds, 2 * d + 1))
        for k, mine, _ in _by_fold(batches, d):
            sums[k] += np.concatenate([mine.sum(0), (mine**2).sum(0), [len(mine)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds), pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS] * folds, pa.int32()), pa.array(np.zeros(folds)), pa.array([s.tobytes() for s in sums], pa.binary())], ["model", "salt", "loss", "g"])

    by_fold = np.zeros((folds, 2 * d + 1))
    for r in _summed(data.mapInArrow(moments, "model int, salt int, loss double, g binary")).collect():
        by_fold[r["model"]] = np.frombuffer(r["g"])
    kept_out = np.concatenate([by_fold.sum(0) - by_fold, by_fold.sum(0)[None]])
    n = np.maximum(kept_out[:, -1:], 1)
    mean = kept_out[:, :d] / n
    scale = np.sqrt(np.maximum(kept_out[:, d : 2 * d] / n - mean**2, 0))
    scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0

    models = [(c, k) for c in range(len(penalties)) for k in range(folds + 1)]
    size = classes * (d + 1)
    running = {m: _Descent(np.zeros(size)) for m in range(len(models))}
    for _ in range(steps):
        live = [m for m, r in running.items() if not r.done]
        if not live:
            break
        raw = []
        for m in live:
            w, k = running[m].ask().reshape(classes, d + 1), models[m][1]
            own = w[:, :-1] / scale[k]
            raw.append(np.concatenate([own, (w[:, -1] - own @ mean[k])[:, None]], 1))
        sent = context.broadcast((live, [models[m][1] for m in live], raw))

        def gradients(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            live, out, raw = sent.value
            losses, sums, weights = np.zeros(len(live)), np.zeros((len(live), size)), np.stack(raw)
            for fold, x, y in _by_fold(batches, d):
                learn = np.array(out) != fold
                if learn.any():
                    loss, g = losses_and_gradients(x, y, weights[learn])
                    losses[learn] += loss
                    sums[learn] += g.reshape(-1, size)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([salt] * len(live), pa.int32()), pa.array(losses), pa.array([s.tobytes() for s in sums], pa.binary())], ["model", "salt", "loss", "g"])

        for r in _summed(data.mapInArrow(gradients, "model int, salt int, loss double, g binary")).collect():
            m = r["model"]
            c, k = penalties[models[m][0]], models[m][1]
            g = np.frombuffer(r["g"]).reshape(classes, d + 1).copy()
            g[:, :-1] = (g[:, :-1] - g[:, -1:] * mean[k]) / scale[k]
            w = running[m].ask().reshape(classes, d + 1)
            flat = w.copy()
            flat[:, -1] = 0
            running[m].tell(0.5 * float((flat**2).sum()) + c * r["loss"], (flat + c * g).ravel(), tolerance * max(1.0, c))
        sent.unpersist()
    weights = np.stack([running[m].x.reshape(classes, d + 1) for m in range(len(models))]).reshape(len(penalties), folds + 1, classes, d + 1)
    return weights, mean, scale


def predicted(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(id, y, fold, penalty, said): what each penalty's model without a row's fold says of it (fold null: what that of all rows says, the last)."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, mean, scale))
    kind = rows.schema["id"].dataType.simpleString()

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean, scale = sent.value
        for batch in batches:
            x, y, fold = _rows(batch, mean.shape[1])
            for c in range(len(weights)):
                said = np.zeros(len(y), np.int32)
                for k in np.unique(fold):
                    at = fold == k
                    said[at] = probabilities((x[at] - mean[k]) / scale[k], weights[c, k]).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.array(np.full(len(y), c, np.int32)), pa.array(said)], ["id", "y", "fold", "penalty", "said"])

    data = rows.select("id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    return data.mapInArrow(say, f"id {kind}, y int, fold int, penalty int, said int")


def macro_f1(said: DataFrame, by: list[str]) -> DataFrame:
    """(by, f1): the mean over classes of F1, a class that is never said or never there counting 0, of rows (by, y, said)."""
    cells = said.groupBy(*by, "y", "said").agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("y") == F.col("said"), F.col("n")).otherwise(0))
    gold = cells.groupBy(*by, F.col("y").alias("label")).agg(F.sum("n").alias("g"), right.alias("r"))
    told = cells.groupBy(*by, F.col("said").alias("label")).agg(F.sum("n").alias("s"))
    both = gold.join(told, [*by, "label"], "full").fillna(0, ["g", "s", "r"])
    return both.groupBy(*by).agg(F.avg(2 * F.col("r") / (F.col("g") + F.col("s"))).alias("f1"))


def cross_validated(rows: DataFrame, label: str = "label", id: str = "id", x: str = "x", penalties: Sequence[float] = PENALTIES, folds: int = FOLDS, **options) -> tuple[dict, DataFrame]:
    """(model, report): the penalty with the best macro-F1 over held-out folds, fitted on all rows, and (penalty, fold, f1), fold null for all folds together.

    rows: id (one row each), x (array), label. Rows with a null label, or with null or non-finite features, take no part. Labels are
    taken in order; they are few and known to the driver. model: labels, mean, scale, coef, intercept, penalty, f1 by penalty.
    """
    whole = F.forall(F.col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clean = rows.where(F.col(label).isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size(x) > 0)).select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(label).alias("label"))
    labels = [r[0] for r in clean.select("label").distinct().orderBy("label").collect()]
    if len(labels) < 2:
        raise ValueError("there must be two labels at least")
    coded = clean.withColumn("y", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1).drop("label")
    dealt = kept(stratified_folds(coded, "y", "id", folds))
    weights, mean, scale = fit(dealt, penalties, folds, len(labels), **options)
    said = kept(predicted(dealt, weights, mean, scale))
    report = macro_f1(said, ["penalty", "fold"]).unionByName(macro_f1(said, ["penalty"]).withColumn("fold", F.lit(None).cast("int")))
    named = F.element_at(F.array(*map(F.lit, penalties)), F.col("penalty") + 1).alias("penalty")
    report = kept(report.select(named, "fold", "f1"))
    scores = {r["penalty"]: r["f1"] for r in report.where("fold is null").collect()}
    best = max(penalties, key=lambda c: scores[c])
    w = weights[list(penalties).index(best), folds]
    return {"labels": labels, "mean": mean[folds], "scale": scale[folds], "coef": w[:, :-1], "intercept": w[:, -1], "penalty": best, "f1": scores, "weights": weights}, report

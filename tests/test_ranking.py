"""Running sums, selection by rank, references of large series and the trainer against plain computations."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import baselines as B, evaluating as E, ranking as R, training as T


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(30), k, r.randrange(5)) for k in range(400)]
    frame = spark.createDataFrame(rows, "key string, x long, id long, v long").repartition(3)
    got = {g.id: (g.n, g.s) for g in R.running_sums(frame, ["x", "id"], {"n": F.lit(1), "s": F.col("v")}, ["key"]).collect()}
    for k in rows:
        before = [o for o in rows if o[0] == k[0] and (o[1], o[2]) < (k[1], k[2])]
        assert got[k[2]] == (len(before), sum(o[3] for o in before))
    assert R.running_sums(frame.limit(0), ["x"], {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("draw", [lambda r: r.gauss(0, 1e6), lambda r: float(r.randrange(3)), lambda r: r.choice([1e308, -1e308, 0.0, 5e-324]), lambda r: 10.0 ** r.randrange(-300, 300)])
def test_selected_ranks(spark, draw, monkeypatch):
    monkeypatch.setattr(R, "RANGES", 16)
    r = random.Random(2)
    rows = [(k, draw(r)) for k in ("a", "b") for _ in range(200)]
    asked = [("a", k) for k in (-1, 0, 99, 100, 199, 200)] + [("b", 7), ("c", 0)]
    got = {(g.key, g.rank): g.value for g in R.selected(spark.createDataFrame(rows, "key string, x double"), ["key"], "x", spark.createDataFrame(asked, "key string, rank long")).collect()}
    by = {k: sorted(x for key, x in rows if key == k) for k in "ab"}
    assert got == {("a", k): by["a"][k] for k in (0, 99, 100, 199)} | {("b", 7): by["b"][7]}


def test_references_of_large_series_are_those_of_small_ones(spark):
    r = random.Random(3)
    rows = [(f"s{k}", x) for k, n in enumerate([1, 2, 3, 40, 41, 200, 300]) for x in ([r.gauss(5, 2) for _ in range(n)] if k < 6 else [1.0] * 250 + [2.0] * 49 + [float("nan")])]
    frame = spark.createDataFrame(rows, "series string, value double")
    small = sorted(map(tuple, B.references(frame, ["series"]).collect()))
    assert sorted(map(tuple, B.references(frame, ["series"], held_values=35).collect())) == small
    assert sorted(map(tuple, B.references(frame, ["series"], held_values=1).collect())) == small
    x = [v for s, v in rows if s == "s5"]
    m = statistics.median(x)
    assert next(s for s in small if s[0] == "s5")[1:] == pytest.approx((round(m, 3), 1.4826 * statistics.median(abs(v - m) for v in x), statistics.median(abs(v - m) for v in x), 200), abs=1e-3)


def test_auc_of_tied_scores(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), float(r.randrange(20))) for _ in range(300)]
    wins = [(a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z]
    assert E.auc(spark.createDataFrame(rows, "y int, x double"), "y", "x").first()[0] == pytest.approx(sum(wins) / len(wins), abs=1e-6)


def test_folds_are_stratified(spark):
    rows = [(k, "a" if k % 3 else "b") for k in range(500)]
    got = R.stratified_folds(spark.createDataFrame(rows, "id long, label string").repartition(3), "label", "id").collect()
    counts = Counter((g.label, g.fold) for g in got)
    assert len(got) == 500 and all(max(v) - min(v) <= 1 for v in [[counts[x, f] for f in range(5)] for x in "ab"])


def made(n=400, d=6, classes=3, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * 10 ** np.arange(d) + 100
    x[:, 3] = 7.0  # a feature that says nothing
    y = ((x - x.mean(0)) / (x.std(0) + 1e-9) @ r.normal(size=(d, classes)) + r.gumbel(size=(n, classes))).argmax(1)
    return x, y


def test_gradient():
    x, y = made(30)
    x = (x - x.mean(0)) / (x.std(0) + 1e-9)
    w = np.random.default_rng(6).normal(size=(3, 7))
    f, g = T.loss_and_gradient(x, y, w)
    for i, j in [(0, 0), (1, 4), (2, 6)]:
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        assert (T.loss_and_gradient(x, y, w + e)[0] - T.loss_and_gradient(x, y, w - e)[0]) / 2e-6 == pytest.approx(g[i, j], rel=1e-4, abs=1e-5)


def test_fit_finds_the_minimum_of_every_fold_and_penalty(spark):
    x, y = made()
    fold = np.arange(len(y)) % 3
    frame = spark.createDataFrame([(x[i].tolist(), int(y[i]), int(fold[i])) for i in range(len(y))], "x array<double>, y int, fold int").repartition(4)
    weights, mean, scale = T.fit(frame, (0.01, 1.0), 3, 3, tolerance=1e-6)
    for k in range(4):
        mine = fold != k
        assert mean[k] == pytest.approx(x[mine].mean(0)) and scale[k][[0, 1, 2, 4, 5]] == pytest.approx(x[mine].std(0)[[0, 1, 2, 4, 5]]) and scale[k][3] == 1
        z = (x[mine] - mean[k]) / scale[k]
        for c, penalty in enumerate((0.01, 1.0)):
            w = weights[c, k]
            flat = w.copy()
            flat[:, -1] = 0
            assert np.abs(flat + penalty * T.loss_and_gradient(z, y[mine], w)[1]).max() < 1e-4  # convex, so this is the minimum


def test_cross_validation(spark):
    x, y = made(600)
    rows = [(i, x[i].tolist(), "abc"[y[i]], 1) for i in range(600)] + [(900, None, "a", 1), (901, [1.0] * 5 + [float("nan")], "a", 1), (902, x[0].tolist(), None, 1)]
    model, report = T.cross_validated(spark.createDataFrame(rows, "id long, x array<double>, label string, fold int"), penalties=(0.001, 0.1, 1.0))
    assert model["labels"] == ["a", "b", "c"] and model["coef"].shape == (3, 6) and model["penalty"] == max(model["f1"], key=model["f1"].get)
    got = {(r.penalty, r.fold): r.f1 for r in report.collect()}
    assert len(got) == 18
    folds = {r.id: r.fold for r in R.stratified_folds(spark.createDataFrame([(i, int(y[i])) for i in range(600)], "id long, y int"), "y", "id").collect()}
    f = np.array([folds[i] for i in range(600)])
    for c, penalty in enumerate((0.001, 0.1, 1.0)):
        said = np.zeros(600, int)
        for k in range(5):
            z = (x - x[f != k].mean(0)) / np.where(x[f != k].std(0) > 1e-9, x[f != k].std(0), 1)
            said[f == k] = T.probabilities(z[f == k], model["weights"][c, k]).argmax(1)
        score = lambda m: np.mean([2 * ((said == a) & (y == a) & m).sum() / (((said == a) & m).sum() + ((y == a) & m).sum()) for a in range(3)])  # noqa: B023, E731
        assert got[penalty, None] == pytest.approx(score(np.ones(600, bool))) and got[penalty, 2] == pytest.approx(score(f == 2))
    assert model["f1"][model["penalty"]] > 0.6
    with pytest.raises(ValueError):
        T.cross_validated(spark.createDataFrame([(1, [1.0], "a")], "id long, x array<double>, label string"))


def test_gradients_of_models_at_once_are_those_of_each(spark, monkeypatch):
    r = np.random.default_rng(6)
    x, y, weights = r.normal(size=(50, 3)), r.integers(0, 4, 50), r.normal(size=(5, 4, 4))
    each = [T.loss_and_gradient(x, y, w) for w in weights]
    for at_once in (1, 140, 1 << 20):
        monkeypatch.setattr(T, "SCORES", at_once)
        losses, sums = T.losses_and_gradients(x, y, weights)
        assert np.allclose(losses, [e[0] for e in each]) and np.allclose(sums, [e[1] for e in each])


def test_blocks_hold_each_row_once_by_fold(spark):
    rows = spark.createDataFrame([([float(k), k / 7], k % 3, k % 4 if k % 9 else None) for k in range(40)], "x array<double>, y int, fold int").coalesce(1)
    blocks = T._blocks(rows, 2).toArrow().to_batches()
    assert sum(b.num_rows for b in blocks) == 1
    got = [(k, *a, b) for k, x, y in T._by_fold(iter(blocks), 2) for a, b in zip(x.tolist(), y.tolist())]
    assert sorted(got) == sorted((k % 4 if k % 9 else -1, float(k), k / 7, k % 3) for k in range(40)) and [g[0] for g in got] == sorted(g[0] for g in got)

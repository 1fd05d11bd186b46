"""Regressions on hashed terms next to a dense solution by Newton's method."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import hashed
from kinfold.operators.hashed import HashedSpec, collisions, fit_hashed, lbfgs

SPEC = HashedSpec(bits=8, tol=1e-10, min_df=2, max_df=0.95)


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    data = []
    for i in range(90):
        y = int(pick.random() < 0.3)
        words = [pick.choice("abcdefgh") * pick.randint(1, 3) for _ in range(pick.randint(0, 12))]
        words += ["yes"] * (y and pick.random() < 0.8) + ["no"] * (not y and pick.random() < 0.6)
        data.append((i, y, pick.randint(1, 3), pick.randint(1, 3), words))
    data.append((90, 0, 1, 1, None))
    df = spark.createDataFrame(data, "id long, y int, fold_1 int, fold_2 int, terms array<string>")
    return df.repartition(3, "id").persist()


def dense(rows, spec):
    """(ids, y, folds, signed counts) of all rows."""
    hashed = rows.select("*", F.transform("terms", lambda t: F.xxhash64(t)).alias("h")).orderBy("id").collect()
    counts = np.zeros((len(hashed), spec.width))
    for k, r in enumerate(hashed):
        for h in r.h or []:
            counts[k, h % spec.width] += 1 if h >= 0 else -1
    return [r.id for r in hashed], np.array([r.y for r in hashed]), [(r.fold_1, r.fold_2) for r in hashed], counts


def newton(counts, y, train, spec):
    """(coefficients with the intercept last, unit vectors of all rows)."""
    n = train.sum()
    df = (counts[train] != 0).sum(0)
    idf = np.where((df >= spec.min_df) & (df <= spec.max_df * n), np.log((1 + n) / (1 + df)) + 1, 0)
    x = counts * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.hstack([x / np.where(norm > 0, norm, 1), np.ones((len(x), 1))])
    a, t = x[train], y[train]
    weight = np.where(t == 1, n / (2 * (t == 1).sum()), n / (2 * (t == 0).sum()))
    ridge = np.append(np.ones(x.shape[1] - 1), 0) / spec.c
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        slope = a.T @ (weight * (p - t)) + ridge * beta
        beta -= np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + np.diag(ridge), slope)
    return beta, x


def test_one_fit_is_the_optimum(rows):
    model = fit_hashed(rows, F.array(F.lit(True)), SPEC)
    ids, y, _, counts = dense(rows, SPEC)
    beta, x = newton(counts, y, np.ones(len(y), bool), SPEC)
    used = model.idf[:, 0] > 0
    assert np.abs(model.beta[used, 0] - beta[:-1][used]).max() < 1e-6
    assert abs(model.intercept[0] - beta[-1]) < 1e-6 and model.n_rows[0] == len(y)
    scores = {r.id: (r.score, r.pred) for r in model.predict(rows, ["id"]).collect()}
    for i, want in zip(ids, x @ beta, strict=True):
        assert abs(scores[i][0] - want) < 1e-5 and scores[i][1] == int(scores[i][0] > 0)


def test_all_folds_and_seeds_together_equal_single_fits(rows):
    places = [(s, k) for s in (1, 2) for k in (1, 2, 3)]
    trained = [F.col(f"fold_{s}") != k for s, k in places]
    tested = [F.col(f"fold_{s}") == k for s, k in places]
    together = fit_hashed(rows, F.array(*trained), SPEC)
    longest = 0
    for m, flag in enumerate(trained):
        alone = fit_hashed(rows, F.array(flag), SPEC)
        longest = max(longest, alone.passes)
        assert np.abs(together.beta[:, m] - alone.beta[:, 0]).max() < 1e-6
        assert np.abs(together.intercept[m] - alone.intercept[0]) < 1e-6
        assert (together.idf[:, m] == alone.idf[:, 0]).all() and together.n_rows[m] == alone.n_rows[0]
    assert together.passes <= longest + 3  # those of the slowest fit, whatever their number
    assert together.gradient.max() <= SPEC.tol
    ids, y, folds, counts = dense(rows, SPEC)
    got = {(r.model, r.id): r.score for r in together.predict(rows, ["id"], F.array(*tested)).collect()}
    assert len(got) == 2 * len(ids)
    beta, x = newton(counts, y, np.array([f[1] != 3 for f in folds]), SPEC)
    for i, f, want in zip(ids, folds, x @ beta, strict=True):
        assert ((5, i) in got) == (f[1] == 3)
        assert f[1] != 3 or abs(got[5, i] - want) < 1e-5


def test_a_fit_of_one_class_or_no_rows_is_an_error(rows):
    with pytest.raises(ValueError):
        fit_hashed(rows, F.array(F.lit(True), F.col("y") == 1), SPEC)
    with pytest.raises(ValueError):
        fit_hashed(rows.filter("false"), F.array(F.lit(True)), SPEC)


def test_small_blocks_and_many_steps(rows, monkeypatch):
    whole = fit_hashed(rows, F.array(F.lit(True)), SPEC)
    monkeypatch.setattr("kinfold.operators.hashed.CHUNK", 100)
    chunked = fit_hashed(rows, F.array(F.lit(True)), SPEC)
    assert np.abs(whole.beta - chunked.beta).max() < 1e-8
    stopped = fit_hashed(rows, F.array(F.lit(True)), HashedSpec(bits=8, tol=1e-10, max_iter=2))
    assert stopped.iterations[0] == 2 and stopped.gradient[0] > 1e-10


def test_collisions_are_counted(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["c"],), (None,), ([],)], "terms array<string>")
    wide, narrow = (collisions(df, HashedSpec(bits=b)).first() for b in (30, 0))
    assert tuple(wide) == (3, 3, 0) and tuple(narrow) == (3, 1, 3)
    assert tuple(collisions(df.filter("false"), SPEC).first()) == (0, 0, 0)


def test_lbfgs_finds_the_least_point_of_a_stretched_bowl():
    scale = np.logspace(0, 4, 12)
    least = np.linspace(-3, 3, 12)
    solver = lbfgs(np.zeros(12), 1e-9, 500)
    x = next(solver)
    try:
        while True:
            x = solver.send((0.5 * (scale * (x - least) ** 2).sum(), scale * (x - least)))
    except StopIteration as end:
        assert np.abs(end.value.x - least).max() < 1e-8 and end.value.steps < 500


@pytest.mark.parametrize("cached", [1, 100, 1 << 18])
def test_sums_of_all_columns_at_once(monkeypatch, cached):
    """Columns were summed one after the other, with as many gathers as fits."""
    monkeypatch.setattr(hashed, "CACHED", cached)
    rng = np.random.default_rng(5)
    keys, at, counts = np.sort(rng.integers(0, 40, 500)) * 2, rng.integers(0, 30, 500), rng.normal(size=500)
    values = rng.normal(size=(30, 7))
    want = np.zeros((81, 7))
    np.add.at(want, keys, counts[:, None] * values[at])
    assert np.abs(hashed._sums(keys, values, at, counts, 81) - want).max() < 1e-12
    assert not hashed._sums(keys[:0], values, at[:0], counts[:0], 81).any()


def test_lbfgs_ends_though_values_are_rounded():
    """Values that hide the last descents cost no extra points: the slope tells."""
    scale, least = np.logspace(0, 3, 12), np.linspace(-3, 3, 12)
    points = {}
    for digits in (None, 9):
        solver = lbfgs(np.zeros(12), 1e-9, 500)
        x, points[digits] = next(solver), 1
        try:
            while True:
                value = 1e3 + 0.5 * (scale * (x - least) ** 2).sum()
                x = solver.send((value if digits is None else round(value, digits), scale * (x - least)))
                points[digits] += 1
        except StopIteration as end:
            assert np.abs(end.value.slope).max() <= 1e-9
    assert points[9] <= 1.1 * points[None]  # 189 of 165 before


def test_long_memory_saves_points_and_stays_bounded():
    """Each point is a pass over the rows and a matrix sent to the driver; with ten pairs of
    steps they grew fast on stretched problems."""
    points = {}
    scale, least = np.logspace(0, 4, 60), np.linspace(-3, 3, 60)
    for memory in (10, hashed.MEMORY):
        solver = lbfgs(np.zeros(60), 1e-6, 5000, memory)
        x, points[memory] = next(solver), 1
        try:
            while True:
                x = solver.send((0.5 * (scale * (x - least) ** 2).sum(), scale * (x - least)))
                points[memory] += 1
        except StopIteration as end:
            assert np.abs(end.value.x - least).max() < 2e-6
    assert points[hashed.MEMORY] < 0.9 * points[10], points
    for bits, fits in ((18, 1), (18, 5), (16, 50), (18, 500)):
        pairs = hashed.remembered(1 << bits, fits)
        assert pairs == hashed.LEAST_MEMORY or pairs * 8 * fits << bits <= hashed.HISTORY_BYTES
    assert hashed.remembered(1 << 18, 5) == hashed.MEMORY


def test_scaled_steps_need_fewer_points():
    """Each point is a pass; steps began with one scale for frequent and rare slots."""
    pick = np.random.default_rng(8)
    seen = 0.3 / np.arange(1, 401)  # shares of the rows that hold each slot
    x = (pick.random((3000, 400)) < seen) * pick.random((3000, 400))
    side = np.where(x @ pick.normal(size=400) + 0.3 * pick.normal(size=3000) > 0, 1.0, -1.0)
    ridge, points, least = 1 / 3000, {}, {}
    curvature = np.append((x * x).sum(0) / 3000, 1.0)
    for scale in (1.0, hashed._scale(curvature[:-1], 3000)):
        solver = lbfgs(np.zeros(401), 1e-6, 5000, 10, scale)
        point, n = next(solver), 1
        try:
            while True:
                z = side * (x @ point[:-1] + point[-1])
                pull = -side / (1 + np.exp(z)) / 3000
                slope = np.append(x.T @ pull + ridge * point[:-1], pull.sum())
                point = solver.send((np.logaddexp(0, -z).mean() + ridge / 2 * point[:-1] @ point[:-1], slope))
                n += 1
        except StopIteration as end:
            points[np.ndim(scale)], least[np.ndim(scale)] = n, end.value
            assert np.abs(end.value.slope).max() <= 1e-6
    assert abs(least[0].value - least[1].value) < 1e-8
    assert points[1] < 0.8 * points[0], points


def test_many_fits_are_solved_in_groups(rows, monkeypatch):
    """All fits' vectors were on the driver at once, whatever their number."""
    flags = [F.col("fold_1") != k for k in (1, 2, 3)] + [F.col("fold_2") != k for k in (1, 2)]
    whole = fit_hashed(rows, F.array(*flags), SPEC)
    monkeypatch.setattr(hashed, "TOGETHER", 2 * SPEC.width)
    assert [len(some) for some in hashed.together(SPEC.width, 5)] == [1, 2, 2]
    parts = fit_hashed(rows, F.array(*flags), SPEC)
    assert np.abs(whole.beta - parts.beta).max() < 1e-6 and (whole.n_rows == parts.n_rows).all()
    assert hashed.together(1 << 30, 2) == [range(0, 1), range(1, 2)]
    monkeypatch.undo()
    for bits, fits in ((18, 5), (16, 50), (16, 5000)):
        assert max(len(some) for some in hashed.together(1 << bits, fits)) << bits <= hashed.TOGETHER


def test_parts_are_summed_as_they_come():
    """All tasks' parts of a chunk were held by one group; now the sums and a batch."""
    batches = [hashed._part(k % 2, np.full(3, float(k))) for k in range(6)]
    found = {b["chunk"][0].as_py(): np.frombuffer(b["part"][0].as_py()).tolist() for b in hashed._added(iter(batches))}
    assert found == {0: [6.0] * 3, 1: [9.0] * 3}

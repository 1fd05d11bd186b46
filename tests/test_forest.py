"""The sparse forest's parts next to plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.functions.features import FEATURES
from kinfold.operators import forest, models


def gini_gain(x, y, w, at):
    def impurity(some):
        t = [w[some & (y == c)].sum() for c in (0, 1)]
        return (t[0] ** 2 + t[1] ** 2) / sum(t)

    left = x < at
    return impurity(left) + impurity(~left) - impurity(np.ones(len(x), bool))


def test_best_split_is_that_of_all_thresholds():
    pick = np.random.default_rng(3)
    for _ in range(20):
        n = 30
        y, w = pick.integers(0, 2, n), pick.integers(1, 4, n).astype(float)
        x = np.where(pick.random((n, 5)) < 0.6, 0, pick.integers(1, 6, (n, 5)) / 4)  # mostly zero
        at, which = np.nonzero(x)
        rows = np.empty(len(at), forest.ENTRY)
        rows["node"], rows["feature"], rows["value"] = 0, which + 7, x[at, which]
        rows["w0"], rows["w1"] = np.where(y[at] == 0, w[at], 0), np.where(y[at] == 1, w[at], 0)
        totals = np.array([[w[y == 0].sum(), w[y == 1].sum()]])
        half = len(rows) // 2
        found = forest._best(totals, pa.table({"entries": [rows[:half].tobytes(), rows[half:].tobytes()]})).to_pylist()
        cuts = [(f, (a + b) / 2) for f in range(5) for a, b in zip(np.unique(x[:, f]), np.unique(x[:, f])[1:], strict=False)]
        best = max(gini_gain(x[:, f], y, w, cut) for f, cut in cuts)
        f, cut = found[0]["feature"] - 7, found[0]["at"]
        assert abs(gini_gain(x[:, f], y, w, cut) - best) < 1e-6
        left = x[:, f] < cut
        assert [found[0]["left0"], found[0]["left1"]] == [w[left & (y == c)].sum() for c in (0, 1)]


def test_rows_are_drawn_once_on_average_and_alike_again():
    ids = pa.array([{"key": k} for k in range(2000)])
    drawn = forest._draws(ids, 50, 9)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03
    assert (drawn == forest._draws(ids, 50, 9)).all() and (drawn != forest._draws(ids, 50, 10)).any()


def test_rows_without_the_feature_go_to_the_left():
    begins, features, values = np.array([0, 1, 2, 2]), np.array([5, 5], "<u8"), np.array([0.2, 0.9])
    row = forest._row(
        n=3, ids=b"", begins=begins.astype("<i8").tobytes(), features=features.tobytes(), entries=values.tobytes()
    )
    block = forest._Block(row, 0)
    level = forest.Level(np.array([5, 6], np.uint64), np.array([0.5, 0.5]), np.array([0, -1]), np.zeros(2))
    nodes = block.moved(level, np.array([[0, 1], [0, 1], [0, -1]], np.int32), *block.coded())
    assert nodes.tolist() == [[0, -1], [1, -1], [0, -1]]


def test_a_fit_takes_all_rows(spark):
    """Beyond 200,000 rows a fit took a sample by hash."""
    n = 200_300
    zeros = {name: F.lit(0.0) for name in FEATURES}
    rows = spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("msg_id"),
        (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("ab"))).otherwise(F.array(F.lit("cd"))).alias("word_terms"),
    )
    model = models.fit_model(rows.withColumns(zeros), models.ModelSpec("forest", trees=2, depth=2), 3)
    assert model.n_rows == n
    assert abs(model.forest.levels[0].share - 0.5).max() < 0.01


def test_large_nodes_are_looked_at_in_parts(spark, monkeypatch):
    """All entries of up to 64 nodes, however many, were in one part."""
    expected = np.array([5.0, 1000.0, 0.0, 30.0, 90.0, 95.0])
    monkeypatch.setattr(forest, "SHARE", 100)
    first, n_parts = forest.shares(expected)
    held = np.zeros(20)
    for e, a, n in zip(expected, first, n_parts, strict=True):
        held[a : a + n] += e / n
    assert n_parts.tolist() == [1, 10, 1, 1, 1, 1] and held.max() < 300
    pick = np.random.default_rng(2)
    words = [[f"w{k}" for k in pick.integers(0, 60, 12)] + ["yes" if i % 2 and i % 7 else "no"] for i in range(400)]
    zeros = {name: F.lit(0.0) for name in FEATURES}
    rows = spark.createDataFrame([(f"m{i}", i % 2, w) for i, w in enumerate(words)], "msg_id string, y int, word_terms array<string>")
    rows = rows.repartition(3).withColumns(zeros | {"n_chars": F.size("word_terms") + F.hash("msg_id") % 5})
    grown = {}
    for share in (3, 1 << 18):
        monkeypatch.setattr(forest, "SHARE", share)
        grown[share] = models.fit_model(rows, models.ModelSpec("forest", trees=30, depth=5), 3).forest
    assert len(grown[3].levels) == 6
    for a, b in zip(grown[3].levels, grown[1 << 18].levels, strict=True):
        assert (a.feature == b.feature).all() and (a.child == b.child).all() and np.abs(a.at - b.at).max() < 1e-12

"""Metrics, summaries and tests against recorded results; votes and cache."""

import pytest
from kinfold.functions.stats import two_sided_p
from kinfold.operators import metrics, votes
from pyspark.sql import functions as F

# Confusion counts (tn, fp, fn, tp) of two recorded runs with five
# folds each, conditions A and B, and the summaries recorded for them.
RUNS = {
    "logreg": [
        ((24, 0, 1, 23), (24, 0, 4, 116)),
        ((24, 0, 1, 23), (24, 0, 7, 113)),
        ((24, 0, 0, 24), (24, 0, 2, 118)),
        ((24, 0, 1, 23), (24, 0, 5, 115)),
        ((24, 0, 1, 23), (24, 0, 5, 115)),
    ],
    "forest": [
        ((23, 1, 2, 22), (23, 1, 3, 117)),
        ((24, 0, 1, 23), (24, 0, 6, 114)),
        ((23, 1, 0, 24), (23, 1, 3, 117)),
        ((24, 0, 2, 22), (24, 0, 6, 114)),
        ((24, 0, 1, 23), (24, 0, 9, 111)),
    ],
}
SUMMARY = {
    "logreg": {
        "A_f1": (0.9829787234042552, 0.009515182882977842),
        "B_f1": (0.9804102752337585, 0.007859193246782002),
        "A_recall": (0.9666666666666668, 0.01863389981249823),
        "B_recall": (0.9616666666666667, 0.015138251770487443),
        "delta_f1": (0.0025684481704969066, 0.0057707675051451865),
        "delta_recall": (0.005000000000000027, 0.011180339887498968),
    },
    "forest": {
        "A_f1": (0.9659461194283449, 0.019288255347949996),
        "B_f1": (0.9752286928757516, 0.00907924171733066),
        "A_recall": (0.95, 0.03486083443891984),
        "B_recall": (0.9549999999999998, 0.020916500663351868),
        "delta_f1": (-0.009282573447406794, 0.02471468624716225),
        "delta_recall": (-0.004999999999999982, 0.03935239651039199),
    },
}


def folds(spark, run):
    rows = [(9, f, c, *m) for f, pair in enumerate(RUNS[run], 1) for c, m in zip("AB", pair, strict=True)]
    counts = spark.createDataFrame(rows, "seed int, fold int, cond string, tn long, fp long, fn long, tp long")
    return metrics.ab_delta(metrics.add_scores(counts))


@pytest.mark.parametrize("run", sorted(RUNS))
def test_recorded_summaries(spark, run):
    got = {r.metric: (r.mean, r.std) for r in metrics.fold_summary(folds(spark, run)).collect()}
    for name, expected in SUMMARY[run].items():
        assert got[name] == pytest.approx(expected, abs=1e-12)


def test_recorded_paired_test(spark):
    row = metrics.paired_ttest(folds(spark, "forest")).first()
    assert row.mean == pytest.approx(-0.00928, abs=1e-5)
    assert row.se == pytest.approx(0.01105, abs=1e-5)
    assert row.t == pytest.approx(-0.84, abs=1e-3)
    assert row.p == pytest.approx(0.448, abs=1e-3)


def test_t_needs_spread(spark):
    df = spark.createDataFrame([(1, f, 0.5) for f in (1, 2, 3)] + [(2, 1, 0.1)], "seed int, fold int, delta_f1 double")
    rows = {r.seed: r for r in metrics.paired_ttest(df).collect()}
    assert rows[1].t is None and rows[1].p is None
    assert rows[2].sd is None and rows[2].t is None


def test_t_tail_probabilities(spark):
    """Two-sided 5% points of the t distribution (published tables)."""
    table = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 5: 2.57058, 10: 2.22814, 29: 2.04523}
    df = spark.createDataFrame([(float(t), n) for n, t in table.items()], "t double, n int")
    for r in df.select(two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-5)


def scored(spark, pairs):
    return spark.createDataFrame([(1, 1, "A", y, p) for y, p in pairs], "seed int, fold int, cond string, y int, pred int")


def test_zero_division_gives_zero(spark):
    row = metrics.binary_metrics(scored(spark, [(1, 0), (0, 0)])).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 0.5)
    row = metrics.binary_metrics(scored(spark, [(0, 0), (0, 0)])).first()
    assert (row.tn, row.fp, row.fn, row.tp, row.recall, row.accuracy) == (2, 0, 0, 0, 0, 1)
    assert metrics.binary_metrics(scored(spark, [(0, 0)]).filter("false")).count() == 0


def test_recorded_matrix_percentages(spark):
    counts = spark.createDataFrame([(1, 1, "B", 81, 19, 4, 96)], "seed int, fold int, cond string, tn long, fp long, fn long, tp long")
    pct = {(r.actual, r.predicted): r.pct for r in metrics.confusion_pct(counts).collect()}
    assert pct == {(0, 0): 81.0, (0, 1): 19.0, (1, 0): 4.0, (1, 1): 96.0}


def test_missing_prediction_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, "a", "phish", "original", 1)], "seed int, fold int, msg_id string, label string, variant_type string, y int")
    none = spark.createDataFrame([], "seed int, msg_id string, pred int")
    with pytest.raises(Exception, match="no prediction for a"):
        metrics.eval_predictions(rows, none).collect()


def test_thresholds_and_ties(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4999, 0.6)], "a double, b double")
    got = df.select(metrics.threshold(F.col("a")).alias("t"), metrics.argmax_class(F.col("a"), F.col("b")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 1)]


def test_votes(spark):
    rows = [("a", 0, "phish", 0.9), ("a", 1, "legit", 0.7), ("b", 0, "legit", 0.6), ("b", 1, "legit", 0.8), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "k string, vote int, label string, confidence double")
    got = {r.k: r for r in votes.majority_vote(df, "k", 2).collect()}
    assert got["a"].label == "phish" and got["a"].confidence == pytest.approx(0.8)
    assert got["b"].label == "legit" and got["b"].raw_confidences == [0.6, 0.8]
    assert got["b"].vote_counts == {"phish": 0, "legit": 2}
    assert got["c"].confidence == 0.5 and got["c"].raw_labels == []
    with pytest.raises(Exception, match="vote number outside"):
        votes.majority_vote(df, "k", 1).collect()


def test_cache_counts_repeats_as_hits(spark):
    uses = spark.createDataFrame([("x",), ("x",), ("x",), ("y",), ("z",)], "cache_key string")
    cache = spark.createDataFrame([("y", 1), ("w", 0)], "cache_key string, answer int")
    assert tuple(votes.cache_stats(uses, cache).first()) == (3, 2, 4)
    assert sorted(r.cache_key for r in votes.cache_misses(uses, cache).collect()) == ["x", "z"]

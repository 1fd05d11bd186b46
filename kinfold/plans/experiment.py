"""Cross-validated robustness experiments.

Folds for all seeds come from one plan. The text is turned into terms once and
written to the shared folder. Logistic regressions of all seeds and folds are fitted
together, in passes over that table which they share; a forest is fitted per (seed,
fold) on a filtered scan. Only models and fold metrics reach the driver.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, Labels
from ..functions.labels import trains
from ..operators.checks import assert_folds_apart
from ..operators.families import group_table, with_groups
from ..operators.hashed import fit_hashed
from ..operators.metrics import ab_delta, binary_metrics, by_condition, fold_summary
from ..operators.models import ModelSpec, fit_model, with_terms
from ..operators.split import fold_columns, fold_rows, group_kfold
from ..session import materialize


def assign_folds(messages: DataFrame, seeds: list[int], k: int, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Every message with y, group_id and its test fold, once per seed."""
    grouped = with_groups(messages, labels)
    return fold_rows(grouped, group_kfold(group_table(grouped), seeds, k))


def cv_predictions(
    messages: DataFrame,
    spec: ModelSpec,
    seeds: list[int],
    k: int,
    labels: Labels = DEFAULT_LABELS,
    parallelism: int = 5,
    family: str | None = None,
) -> DataFrame:
    """(seed, fold, msg_id, cond, y, pred) of all test rows of all folds.

    A family on both sides of a fold is an error before anything is fitted.
    """
    keep = ["msg_id", "label", "variant_type", "y"]
    grouped = with_groups(messages, labels, family).select(*keep, "group_id", "text")
    placed = fold_columns(grouped, group_kfold(group_table(grouped), seeds, k), seeds)
    terms = materialize(with_terms(placed, spec), "terms")
    assert_folds_apart(terms, [f"fold_{s}" for s in seeds])

    places = [(seed, number) for seed in seeds for number in range(1, k + 1)]
    if spec.kind == "logreg":
        return by_condition(_together(terms, spec, places, keep, labels), labels)

    def one(place: tuple[int, int]) -> DataFrame:
        seed, number = place
        tested = F.col(f"fold_{seed}") == number
        model = fit_model(terms.filter(~tested & trains(labels)), spec, seed)
        at = [F.lit(seed).alias("seed"), F.lit(number).alias("fold")]
        return model.predict(terms.filter(tested), keep).select(*at, *keep, "pred")

    # Fits are independent Spark jobs: several at a time, as MLlib's own
    # cross-validator does.
    with ThreadPool(min(parallelism, len(places))) as pool:
        scored = pool.map(inheritable_thread_target(messages.sparkSession)(one), places)
    return by_condition(reduce(DataFrame.unionByName, scored), labels)


def _together(
    terms: DataFrame, spec: ModelSpec, places: list[tuple[int, int]], keep: list[str], labels: Labels
) -> DataFrame:
    """Predictions of all test rows, each by the model of its seed and fold, from fits of
    all of them in one optimisation."""
    tested = [F.coalesce(F.col(f"fold_{seed}") == number, F.lit(False)) for seed, number in places]
    trained = [F.coalesce((F.col(f"fold_{seed}") != number) & trains(labels), F.lit(False)) for seed, number in places]
    rows = terms.withColumnRenamed("word_terms", "terms")
    models = fit_hashed(rows, F.array(*trained), spec.hashed)
    scored = models.predict(rows, keep, F.array(*tested))
    at = [F.element_at(F.array(*[F.lit(p[i]) for p in places]), F.col("model") + 1) for i in (0, 1)]
    return scored.select(at[0].alias("seed"), at[1].alias("fold"), *keep, "pred")


def run_cv(
    messages: DataFrame,
    spec: ModelSpec,
    seeds: list[int],
    k: int = 5,
    labels: Labels = DEFAULT_LABELS,
    family: str | None = None,
) -> DataFrame:
    """Metrics per (seed, fold, condition), written once: predicting is not
    repeated by the summaries that follow."""
    return materialize(binary_metrics(cv_predictions(messages, spec, seeds, k, labels, family=family)), "metrics")


def cv_summary(metrics: DataFrame) -> DataFrame:
    return fold_summary(ab_delta(metrics))

"""Binary metrics per (seed, fold, condition), deltas, summaries and tests.

Rows are reduced to four counts per key with partial aggregation; everything
after that works on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, Labels
from ..functions.labels import conditions
from ..functions.stats import two_sided_p

KEYS = ["seed", "fold", "cond"]
SERIES = ("A_f1", "B_f1", "A_recall", "B_recall", "delta_f1", "delta_recall")


def threshold(score: Column, at: float = 0.5) -> Column:
    return (score >= at).cast("int")


def argmax_class(negative_logit: Column, positive_logit: Column) -> Column:
    """1 when the positive logit is strictly larger: a tie is class 0."""
    return (positive_logit > negative_logit).cast("int")


def by_condition(rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Scored test rows once per condition they belong to."""
    return rows.withColumn("cond", F.explode(conditions(labels)))


def eval_predictions(
    rows: DataFrame, predictions: DataFrame, on: list[str] = ("seed", "msg_id"), labels: Labels = DEFAULT_LABELS
) -> DataFrame:
    """Fold rows with their stored prediction; a missing one is an error.

    One prediction per (seed, msg_id). Each row is joined once, its conditions
    are exploded afterwards.
    """
    absent = F.raise_error(F.concat(F.lit("no prediction for "), F.col("msg_id"))).cast("int")
    joined = rows.join(predictions.withColumnRenamed("pred", "_pred"), list(on), "left")
    scored = joined.withColumn("pred", F.coalesce(F.col("_pred"), absent)).drop("_pred")
    return by_condition(scored, labels)


def confusion(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    y, p = F.col("y"), F.col("pred")
    return scored.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def add_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate; 0 for 0/0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": _ratio(fp, fp + tn),
        }
    )


def binary_metrics(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return add_scores(confusion(scored, keys))


def confusion_pct(counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The matrix in long form with each cell as percent of its actual class."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for c, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )
    long = counts.select(*keys, F.inline(cells))
    actual = F.sum("n").over(Window.partitionBy(*keys, "actual"))
    return long.withColumn("pct", 100 * _ratio(F.col("n"), actual))


def ab_delta(metrics: DataFrame, keys: list[str] = ("seed", "fold")) -> DataFrame:
    """One row per fold: A and B side by side and A minus B."""

    def of(cond: str, name: str) -> Column:
        return F.max(F.when(F.col("cond") == cond, F.col(name)))

    wide = metrics.groupBy(*keys).agg(
        *[of(c, m).alias(f"{c}_{m}") for m in ("f1", "recall") for c in ("A", "B")]
    )
    return wide.withColumns(
        {f"delta_{m}": F.col(f"A_{m}") - F.col(f"B_{m}") for m in ("f1", "recall")}
    )


def _long(folds: DataFrame, keys: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("value")) for s in SERIES])
    return folds.select(*keys, F.inline(entries))


def fold_summary(folds: DataFrame, keys: list[str] = ("seed",)) -> DataFrame:
    """(keys, metric, mean, std, n): sample deviation, 0 for a single fold."""
    keys = list(keys)
    return (
        _long(folds, keys)
        .groupBy(*keys, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
            F.count("value").alias("n"),
        )
    )


def paired_ttest(folds: DataFrame, value: str = "delta_f1", keys: list[str] = ("seed",)) -> DataFrame:
    """Paired t-test of the per-fold deltas: t and p are null without spread."""
    stats = folds.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    tested = stats.withColumns(
        {
            "se": F.col("sd") / F.sqrt(F.col("n").cast("double")),
            "df": F.col("n") - 1,
        }
    ).withColumn("t", F.when(F.col("se") > 0, F.try_divide(F.col("mean"), F.col("se"))))
    return tested.withColumn("p", F.when(F.col("t").isNotNull(), two_sided_p(F.col("t"), F.col("df"))))


def seed_sweep(folds: DataFrame) -> DataFrame:
    """(seed, metric, value): fold means per seed, all seeds in one job."""
    return fold_summary(folds).select("seed", "metric", F.col("mean").alias("value"))


def chart_series(folds: DataFrame) -> DataFrame:
    """(chart, seed, x, y, err): bars A/B, deltas by fold, and means by seed."""
    summary = fold_summary(folds)
    bars = summary.filter(~F.col("metric").startswith("delta")).select(
        F.concat(F.lit("bars_"), F.substring_index("metric", "_", -1)).alias("chart"),
        "seed",
        F.substring_index("metric", "_", 1).alias("x"),
        F.col("mean").alias("y"),
        F.col("std").alias("err"),
    )
    deltas = (
        _long(folds, ["seed", "fold"])
        .filter(F.col("metric").startswith("delta"))
        .select(
            F.concat(F.col("metric"), F.lit("_by_fold")).alias("chart"),
            "seed",
            F.col("fold").cast("string").alias("x"),
            F.col("value").alias("y"),
            F.lit(0.0).alias("err"),
        )
    )
    sweep = summary.filter(F.col("metric").startswith("delta")).select(
        F.concat(F.col("metric"), F.lit("_by_seed")).alias("chart"),
        "seed",
        F.col("seed").cast("string").alias("x"),
        F.col("mean").alias("y"),
        F.lit(0.0).alias("err"),
    )
    return bars.unionByName(deltas).unionByName(sweep)


def value_counts(df: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(section, value, n) for all sections of the dataset report in one pass."""
    positive = F.col("label") == labels.positive
    variant = positive & (F.col("variant_type") == labels.variant)
    sections = F.array(
        F.struct(F.lit("label").alias("section"), F.col("label").alias("value")),
        F.when(positive, F.struct(F.lit("scenario").alias("section"), F.col("scenario").alias("value"))),
        F.when(positive, F.struct(F.lit("variant_type").alias("section"), F.col("variant_type").alias("value"))),
        F.when(variant, F.struct(F.lit("strategy").alias("section"), F.col("paraphrase_strategy").alias("value"))),
    )
    return (
        df.select(F.explode(F.filter(sections, lambda s: s.isNotNull())).alias("s"))
        .filter(F.col("s.value").isNotNull())
        .groupBy("s.section", "s.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def length_stats(df: DataFrame, length: str = "length_words", labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(section, n, min, p25, median, p75, max, mean) for all rows and per label.

    Rows first collapse into a histogram of lengths; the exact percentiles
    (linear, cut to whole words) are then weighted by its counts.
    """
    histogram = (
        df.select(F.explode(F.array(F.lit("all"), F.col("label"))).alias("section"), F.col(length).alias("len"))
        .groupBy("section", "len")
        .agg(F.count(F.lit(1)).alias("c"))
    )

    def at(q: float) -> Column:
        return F.percentile("len", F.lit(q), F.col("c")).cast("int")

    return histogram.groupBy("section").agg(
        F.sum("c").alias("n"),
        F.min("len").alias("min"),
        at(0.25).alias("p25"),
        at(0.5).alias("median"),
        at(0.75).alias("p75"),
        F.max("len").alias("max"),
        (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean"),
    )

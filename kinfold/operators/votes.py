"""Majority votes over external answers, and the prediction cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, Labels
from .joins import skew_join


def majority_vote(
    votes: DataFrame, key: str, n_votes: int, labels: Labels = DEFAULT_LABELS
) -> DataFrame:
    """One row per key from (key, vote, label, confidence), vote = 0..n_votes-1.

    A tie goes to the positive label; confidence is the mean, 0.5 without any.
    The raw answers are kept by vote position, so their lists are as long as
    `n_votes` by construction; a position beyond it is an error.
    """
    beyond = F.raise_error(F.lit(f"vote number outside 0..{n_votes - 1}")).cast("int")
    vote = F.when(F.col("vote").between(0, n_votes - 1), F.col("vote")).when(
        F.col("vote").isNotNull(), beyond
    )
    # Labels travel as 0/1 so that the aggregation buffers stay fixed-width.
    y = F.when(F.col("label") == labels.positive, 1).when(F.col("label") == labels.negative, 0)
    coded = votes.select(key, vote.alias("vote"), y.alias("y"), "confidence")
    name = lambda c: F.when(c == 1, labels.positive).when(c == 0, labels.negative)
    raw = [(F.max(F.when(F.col("vote") == i, F.col("y"))).alias(f"_y{i}")) for i in range(n_votes)]
    raw += [(F.max(F.when(F.col("vote") == i, F.col("confidence"))).alias(f"_c{i}")) for i in range(n_votes)]
    counted = coded.groupBy(key).agg(
        F.count_if(F.col("y") == 1).alias("n_positive"),
        F.count_if(F.col("y") == 0).alias("n_negative"),
        F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("confidence"),
        *raw,
    )

    def listed(cells: list[Column]) -> Column:
        return F.filter(F.array(*cells), lambda c: c.isNotNull())

    return counted.select(
        key,
        name((F.col("n_positive") >= F.col("n_negative")).cast("int")).alias("label"),
        "confidence",
        F.create_map(
            F.lit(labels.positive), F.col("n_positive"), F.lit(labels.negative), F.col("n_negative")
        ).alias("vote_counts"),
        listed([name(F.col(f"_y{i}")) for i in range(n_votes)]).alias("raw_labels"),
        listed([F.col(f"_c{i}") for i in range(n_votes)]).alias("raw_confidences"),
    )


def cache_lookup(rows: DataFrame, cache: DataFrame, key: str = "cache_key", spread: str = "msg_id") -> DataFrame:
    """Rows with the cached answer and `hit`. The cache holds a key once, the
    rows may hold it any number of times: hot keys are split."""
    marked = cache.withColumn("_hit", F.lit(True))
    return (
        skew_join(rows, marked, [key], [spread], how="left")
        .withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_hit")
    )


def cache_misses(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """The distinct keys that must still be asked for."""
    return rows.select(key).distinct().join(cache.select(key), key, "left_anti")


def save_answers(cache: DataFrame, answers: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache with new answers merged in, one row per key; a new answer replaces
    an old one. Keys without an answer stay out; columns that one side lacks are
    null there."""
    ranked = cache.withColumn("_new", F.lit(0)).unionByName(answers.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "_new")]
    merged = ranked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return merged.select(key, *[F.col(f"_row.{c}") for c in rest])


def write_cache(cache: DataFrame, path: str) -> None:
    """Into a folder of its own: a reader of the old one is not disturbed."""
    cache.write.mode("errorifexists").parquet(path)


def cache_stats(uses: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Hits, misses and final entries of a run that adds its answers as it goes.

    The first use of an absent key misses, every further use hits. Uses are
    counted per key before the cache is joined, so repeats cost nothing.
    """
    per_key = uses.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    known = per_key.join(cache.select(key, F.lit(1).alias("_in")), key, "left")
    totals = known.agg(
        F.coalesce(F.sum(F.col("uses") - F.when(F.col("_in").isNull(), 1).otherwise(0)), F.lit(0)).alias("hits"),
        F.count_if(F.col("_in").isNull()).alias("misses"),
    )
    entries = cache.agg(F.count(F.lit(1))).scalar()
    return totals.withColumn("entries", entries + F.col("misses"))

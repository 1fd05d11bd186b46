"""Originals, their variants, and what is missing between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, STRATEGIES, Labels
from ..functions.ids import id_index, legit_id, phish_id
from ..functions.labels import group_id, is_original, is_variant, label_to_int, require_columns
from .joins import skew_join, skip_existing


def with_groups(df: DataFrame, labels: Labels = DEFAULT_LABELS, family: str | None = None) -> DataFrame:
    """Add `y` (1 positive, 0 negative) and `group_id`, the family key: taken from the
    base id, or from column `family` where rows of either class can be related."""
    require_columns(df)
    key = F.col(family) if family else group_id(labels)
    return df.withColumns({"y": label_to_int(F.col("label"), labels), "group_id": key})


def group_table(df: DataFrame) -> DataFrame:
    """One row per family with its class: positive when any member is."""
    return df.groupBy("group_id").agg(F.max("y").alias("y"))


def family_sizes(df: DataFrame, strategies=tuple(STRATEGIES.values()), labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Per base: how many variants, in total and per strategy, and the id range.

    Counts instead of member lists: a list would pull a whole family into one
    row. The members themselves are `family_rows`.
    """
    return (
        df.filter(is_variant(labels))
        .groupBy("base_msg_id")
        .agg(
            F.count(F.lit(1)).alias("n_variants"),
            *[F.count_if(F.col("paraphrase_strategy") == s).alias(f"n_{s}") for s in strategies],
        )
    )


def family_rows(df: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Every variant next to its original (base_text); orphans are left out."""
    originals = df.filter(is_original(labels)).select(
        F.col("msg_id").alias("base_msg_id"), F.col("text").alias("base_text")
    )
    return skew_join(df.filter(is_variant(labels)), originals, ["base_msg_id"], ["msg_id"])


def orphan_variants(df: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Variants whose original is absent, and those that name none.

    Decided per distinct base id, then carried back to the rows; one count of
    the base ids serves both.
    """
    variants = df.filter(is_variant(labels))
    originals = df.filter(is_original(labels)).select(F.col("msg_id").alias("base_msg_id"))
    counts = variants.groupBy("base_msg_id").agg(F.count(F.lit(1)).alias("_rows"))
    absent = counts.filter("base_msg_id IS NOT NULL").select("base_msg_id")
    absent = absent.join(originals, "base_msg_id", "left_anti")
    orphans = skew_join(variants, absent, ["base_msg_id"], ["msg_id"], counts=counts)
    return orphans.unionByName(variants.filter("base_msg_id IS NULL"))


def missing_variants(df: DataFrame, strategies: dict = STRATEGIES, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """The ids still to be made: each original times each strategy, less those there."""
    codes = F.explode(
        F.array(
            *[F.struct(F.lit(code).alias("code"), F.lit(name).alias("name")) for code, name in strategies.items()]
        )
    )
    wanted = (
        df.filter(is_original(labels))
        .select(F.col("msg_id").alias("base_msg_id"), "scenario", codes.alias("s"))
        .select(
            phish_id(F.col("scenario"), id_index(F.col("base_msg_id")), F.col("s.code")).alias("msg_id"),
            "base_msg_id",
            "scenario",
            F.col("s.name").alias("paraphrase_strategy"),
        )
    )
    return skip_existing(wanted, df.filter(is_variant(labels)))


def quota_gap(
    df: DataFrame,
    targets: dict[str, int],
    negative_scenario: str,
    negative_target: int,
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Per scenario the indices count+1 .. target that are still to be made.

    The targets are a map literal: a scenario with no rows yet appears too.
    """
    every = {**targets, negative_scenario: negative_target}
    pairs = [F.lit(v) for name, n in every.items() for v in (name, n)]
    wanted = df.sparkSession.range(1).select(F.explode(F.create_map(*pairs)).alias("scenario", "target"))
    have = (
        df.filter((F.col("variant_type") == labels.original) & F.col("scenario").isin(list(every)))
        .groupBy("scenario")
        .agg(F.count(F.lit(1)).alias("have"))
    )
    gap = (
        wanted.join(have, "scenario", "left")
        .fillna({"have": 0})
        .filter(F.col("have") < F.col("target"))
        .select("scenario", "have", "target", F.explode(F.sequence(F.col("have") + 1, F.col("target").cast("bigint"))).alias("idx"))
    )
    return gap.withColumn(
        "msg_id",
        F.when(F.col("scenario") == negative_scenario, legit_id(F.col("idx"))).otherwise(
            phish_id(F.col("scenario"), F.col("idx"), F.lit("orig"))
        ),
    )


def sort_by_index(df: DataFrame) -> DataFrame:
    """Originals in reading order: scenario, then the number inside the id."""
    return df.orderBy("scenario", id_index(F.col("msg_id")), "msg_id")

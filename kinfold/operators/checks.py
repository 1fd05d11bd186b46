"""Leakage and disjointness checks. Violations come back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, Labels
from ..functions.labels import is_variant


def leakage_check(split_rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(rule, family_id, n_rows) of every broken rule; empty when clean.

    `split_rows` has `split` and the message columns. Rules: a variant in train;
    a test variant whose original is not in test; a family on both sides. All
    three come from one aggregation by family, with partial counts.
    """
    family = F.when(is_variant(labels), F.col("base_msg_id")).otherwise(F.col("msg_id"))
    train = F.col("split") == "train"
    per_family = split_rows.groupBy(family.alias("family_id")).agg(
        F.count_if(train & is_variant(labels)).alias("variant_in_train"),
        F.count_if(~train & is_variant(labels)).alias("_test_variants"),
        F.count_if((F.col("split") == "test_original") & ~is_variant(labels)).alias("_test_bases"),
        F.count_if(train).alias("_train"),
        F.count_if(~train).alias("_test"),
    )
    rules = {
        "variant_in_train": F.col("variant_in_train"),
        "base_not_in_test": F.when(F.col("_test_bases") == 0, F.col("_test_variants")).otherwise(0),
        "family_on_both_sides": F.when(
            (F.col("_train") > 0) & (F.col("_test") > 0), F.col("_train") + F.col("_test")
        ).otherwise(0),
    }
    broken = F.array(*[F.struct(F.lit(r).alias("rule"), n.cast("bigint").alias("n_rows")) for r, n in rules.items()])
    return (
        per_family.select("family_id", F.explode(broken).alias("b"))
        .select("b.rule", "family_id", "b.n_rows")
        .filter(F.col("n_rows") > 0)
    )


def assert_no_leakage(split_rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> None:
    found = leakage_check(split_rows, labels).orderBy("rule", "family_id").limit(5).collect()
    if found:
        raise ValueError(f"leakage, first cases: {[tuple(r) for r in found]}")


def assert_folds_apart(rows: DataFrame, columns: list[str], group: str = "group_id") -> None:
    """A family with rows in two folds of one seed is an error."""
    apart = [F.min(c) == F.max(c) for c in columns]
    broken = rows.groupBy(group).agg(*[a.alias(f"_{i}") for i, a in enumerate(apart)])
    whole = " AND ".join(f"coalesce(_{i}, false)" for i in range(len(columns)))
    found = broken.filter(f"NOT ({whole})").select(group).limit(5).collect()
    if found:
        raise ValueError(f"families in several folds, or in none: {[r[0] for r in found]}")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; empty when the sides are disjoint.

    Both sides hold a key once before they meet: copies merge map-side.
    """
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")

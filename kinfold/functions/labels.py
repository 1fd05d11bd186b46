"""Label, family and role expressions over the message schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, REQUIRED_COLUMNS, Labels


def require_columns(df: DataFrame, columns=REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def label_to_int(label: Column, labels: Labels = DEFAULT_LABELS) -> Column:
    """1 / 0, and a runtime error for any other value, null included."""
    return (
        F.when(label == labels.positive, F.lit(1))
        .when(label == labels.negative, F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(label, F.lit("null")))).cast("int")
        )
    )


def is_variant(labels: Labels = DEFAULT_LABELS) -> Column:
    return (F.col("label") == labels.positive) & (F.col("variant_type") == labels.variant)


def is_original(labels: Labels = DEFAULT_LABELS) -> Column:
    """Positive originals only: negatives carry the same variant_type."""
    return (F.col("label") == labels.positive) & (F.col("variant_type") == labels.original)


def is_negative(labels: Labels = DEFAULT_LABELS) -> Column:
    return (F.col("label") == labels.negative) | (
        F.coalesce(F.col("variant_type"), F.lit("")) == labels.negative
    )


def group_id(labels: Labels = DEFAULT_LABELS) -> Column:
    """Family key: a variant belongs to its base, every other row to itself."""
    orphan = F.raise_error(F.concat(F.lit("variant without base_msg_id: "), F.col("msg_id"))).cast("string")
    return F.when(is_variant(labels), F.coalesce(F.nullif(F.col("base_msg_id"), F.lit("")), orphan)).otherwise(
        F.col("msg_id")
    )


def role(labels: Labels = DEFAULT_LABELS) -> Column:
    return (
        F.when(is_original(labels), F.lit("positive_original"))
        .when(is_variant(labels), F.lit("positive_variant"))
        .when(is_negative(labels), F.lit("negative"))
    )


def trains(labels: Labels = DEFAULT_LABELS) -> Column:
    """Models are fitted on negatives and positive originals only."""
    return (F.col("label") == labels.negative) | is_original(labels)


def in_condition(name: str, labels: Labels = DEFAULT_LABELS) -> Column:
    """A = negatives + originals, B = negatives + variants."""
    positives = {"A": is_original, "B": is_variant}[name](labels)
    return (F.col("label") == labels.negative) | positives


def conditions(labels: Labels = DEFAULT_LABELS) -> Column:
    """The test conditions a row belongs to, to be exploded after scoring."""
    return F.filter(
        F.array(*[F.when(in_condition(c, labels), F.lit(c)) for c in ("A", "B")]),
        lambda c: c.isNotNull(),
    )

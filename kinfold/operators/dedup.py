"""Hash back-fill and keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compute_once, normalize_text, text_hash, word_count
from .joins import required

# Rank of a source in ord: room for 2^56 positions within each source.
SOURCE_STRIDE = 1 << 56


def merge_sources(*sources: DataFrame, position: str = "pos") -> DataFrame:
    """Union the sources in order; `ord` sorts by source, then by position."""
    merged = None
    for rank, source in enumerate(sources):
        ranked = source.withColumn(
            "ord", F.lit(rank * SOURCE_STRIDE) + F.col(position).cast("bigint")
        ).drop(position)
        merged = ranked if merged is None else merged.unionByName(ranked, allowMissingColumns=True)
    return merged


def backfill(df: DataFrame) -> DataFrame:
    """Normalize the text; fill absent hashes and absent or zero lengths.

    A stored hash is kept. Empty text without one stays null, to be dropped.
    """
    clean = compute_once(df, text=normalize_text(F.col("text")))
    hashed = F.when(F.col("text") != "", text_hash(F.col("text")))
    return clean.withColumns(
        {
            "text_hash": F.coalesce(F.nullif(F.col("text_hash"), F.lit("")), hashed),
            "length_words": F.coalesce(
                F.nullif(F.col("length_words"), F.lit(0)), word_count(F.col("text"))
            ).cast("int"),
        }
    )


def dedup_first(df: DataFrame, key: str = "text_hash", ord: str = "ord") -> DataFrame:
    """The first row of every key by `ord`; rows without a key are dropped, a row
    without `ord` is an error.

    min_by is an aggregate: each task forwards one row per key, so the copies
    of a hot text are gone before the shuffle, and the text travels once.
    """
    rest = [c for c in df.columns if c != key]
    return (
        required(df, ord)
        .filter(F.coalesce(F.col(key), F.lit("")) != "")
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(ord)).alias("_row"))
        .select(key, "_row.*")
        .select(*df.columns)
    )

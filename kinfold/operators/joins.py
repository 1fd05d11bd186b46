"""Joins: many-to-one with hot keys split, plus the anti-join operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DUPLICATE, OK
from ..session import materialize
from .sketch import key_sketch


def unique_rows(df: DataFrame, on: list[str]) -> DataFrame:
    """`df`, and an error when a key comes twice: a join on it would repeat rows."""
    rest = [c for c in df.columns if c not in on]
    key = F.concat_ws(" ", *[F.col(k).cast("string") for k in on])
    twice = F.raise_error(F.concat(F.lit("more than one row for "), key)).cast("bigint")
    once = df.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row")
    )
    # The count is read by the filter, so the check cannot be pruned away.
    return once.filter(F.when(F.col("_n") == 1, F.lit(1)).otherwise(twice) == 1).select(
        *on, *[F.col(f"_row.{c}") for c in rest]
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    share: int | None = None,
) -> DataFrame:
    """Join many rows of `left` to the one row of `right` that shares their key.

    One key may hold a third of `left`. A key with more than a task's fair share
    of the rows, the total over the number of shuffle partitions, is cut into
    slices of that size by a hash of the `spread` columns, and its single right
    row is repeated once per slice. There are fewer such keys than partitions,
    by arithmetic, so the broadcast table of them has a bound that is no cut.
    Null keys match nothing and are spread over all partitions. `counts`, rows
    (key..., _rows), saves the count where the caller has it; a key that comes
    twice in `right` is an error. `share` sets the number of shares, for tests.
    """
    spark = left.sparkSession
    parts = share or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    fair = F.greatest(F.ceil(counts.agg(F.sum("_rows")).scalar() / F.lit(parts)), F.lit(1))
    hot = counts.filter((F.col("_rows") > fair) & ~_no_key(on))
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("_rows") / fair).cast("int").alias("_slices")))
    slices = F.when(_no_key(on), F.lit(parts)).otherwise(F.coalesce(F.col("_slices"), F.lit(1)))
    sliced = (
        left.join(hot, on, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread), slices).cast("int"))
        .drop("_slices")
    )
    repeated = (
        unique_rows(right.filter(~_no_key(on)), on)
        .join(hot, on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
        .drop("_slices")
    )
    return sliced.join(repeated, [*on, "_slice"], how).drop("_slice")


def _no_key(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])


def required(df: DataFrame, column: str) -> DataFrame:
    """`df`, and an error for a row where the column is null."""
    kind = df.schema[column].dataType
    missing = F.raise_error(F.lit(f"a row has no {column}")).cast(kind)
    return df.withColumn(column, F.coalesce(F.col(column), missing))


def skip_existing(wanted: DataFrame, existing: DataFrame, key: str = "msg_id") -> DataFrame:
    """Rows whose id is not there yet."""
    return wanted.join(existing.select(key), key, "left_anti")


def first_uses(df: DataFrame, known: DataFrame | None = None, key: str = "text_hash", ord: str = "ord") -> DataFrame:
    """(key, ord) of the first row per key, less the keys of `known`.

    Partial minima leave each task with one row per key, so a text copied into
    a third of all rows costs no more than any other, and both sides of the
    anti-join hold a key once. A row without `ord` is an error.
    """
    firsts = required(df, ord).filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(ord).alias(ord))
    if known is not None:
        firsts = firsts.join(known.select(key).distinct(), key, "left_anti")
    return firsts


def flag_duplicates(
    df: DataFrame, known: DataFrame | None = None, key: str = "text_hash", ord: str = "ord"
) -> DataFrame:
    """Add `status`: ok for the first new row of a key, else duplicate_hash.

    The flags come back over `ord`, unique in the data, never over the key:
    copies of one text spread over all tasks. Null `ord` is an error.
    """
    winners = first_uses(df, known, key, ord).select(ord, F.lit(True).alias("_first"))
    return (
        df.join(winners, ord, "left")
        .withColumn("status", F.when(F.col("_first"), OK).otherwise(DUPLICATE))
        .drop("_first")
    )


def reject_known(df: DataFrame, known: DataFrame, key: str = "text_hash", ord: str = "ord") -> DataFrame:
    """Rows whose key is not in `known`, every copy kept.

    Decided once per distinct key and carried back by a join that splits hot
    keys; one count of the keys serves both. Of `known` only keys that a sketch of
    the rows' keys lets pass leave the scan: what is shuffled of it falls with what
    it has in common with the rows. The join that follows is exact.
    """
    counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "key-counts")
    likely = known.filter(key_sketch(counts, key).may_hold(key)).select(key).distinct()
    fresh = counts.select(key).join(likely, key, "left_anti")
    return skew_join(df, fresh, [key], [ord], counts=counts)

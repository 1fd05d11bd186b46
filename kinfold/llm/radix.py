"""Exact duplicates by distributed radix partitioning, most significant bytes first.

A document is the byte string of its length and its normalised text. Every round
splits the groups by their next bytes, all of them at once: rows are counted by
(group, next bytes) with map-side partial counts, groups of one row are done and
leave, and the others go on with the bytes after. Rows of a group have the same
length, so a group ends as a whole, and those who ended together are equal byte
by byte; no digest decides. The strides grow, which leaves a handful of rounds
for any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HEAD = 56  # bytes looked at in the first round, besides the length
STRIDE, GROWTH = 4096, 16  # bytes in the second round, and by how much each later one takes more


def one_space(text: Column) -> Column:
    """Runs of space, tab, line feed, vertical tab, form feed and return as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, doc), a row per input row.

    Texts are equal when identical after `one_space`; null counts as empty. Of
    equal texts the row of the smallest id stays (null ids last), and of rows
    that repeat an id just one. `doc` is a struct of the columns to carry.
    An empty table gives no rows.
    """
    whole = text_col in carry
    stored = df[text_col] if whole else one_space(df[text_col])
    rest = [df[c].alias(c) for c in carry if c != text_col]
    staged = materialize(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            df[id_col].alias("id"),
            stored.alias("stored"),
            (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("doc"),
            one_space(df[text_col]).cast("binary").alias("body"),
        ).select(
            *["row", "id", "stored", "doc"],
            F.octet_length("body").alias("n_bytes"),
            F.substring("body", 1, HEAD).alias("head"),
            F.sha2("body", 256).alias("sha"),
        ),
        "radix-texts",
    )
    body = (one_space(F.col("stored")) if whole else F.col("stored")).cast("binary")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    counts = [F.count(F.lit(1)).alias("n"), first]

    def shared(keys: DataFrame) -> DataFrame:
        """Groups of several rows, named by the row of their first member. Always
        joined by sorting: texts move once a round at any size, hot groups split."""
        return materialize(keys.filter("n > 1"), "radix-groups").hint("merge")

    groups = shared(staged.groupBy("n_bytes", "head").agg(*counts))
    met = staged.select("row", "id", "stored", "n_bytes", "head").join(groups, ["n_bytes", "head"])
    active = materialize(met.select("row", "id", "n", "first", _after(body, HEAD).alias("rest")), "radix-round")
    ended: DataFrame | None = None
    stride = STRIDE
    while True:
        done = active.filter(F.octet_length("rest") == 0).select("row", "n", "first")
        ended = done if ended is None else ended.unionAll(done)
        going = active.filter(F.octet_length("rest") > 0)
        if going.isEmpty():
            break
        group = F.col("first.row").alias("group")
        split = going.select("row", "id", group, "rest", F.substring("rest", 1, stride).alias("head"))
        groups = shared(split.groupBy("group", "head").agg(*counts))
        met = split.join(groups, ["group", "head"])
        active = materialize(met.select("row", "id", "n", "first", _after(F.col("rest"), stride).alias("rest")), "radix-round")
        stride *= GROWTH
    known = staged.select("row", "id", "sha", "doc", *["stored"] * whole).join(ended.hint("merge"), "row", "left")
    fields = [F.col("stored" if c == text_col else f"doc.{c}").alias(c) for c in carry]
    return known.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        (F.struct(*fields) if fields else F.col("doc")).alias("doc"),
    )


def _after(column: Column, n: int) -> Column:
    return F.substring(column, n + 1, 2**31 - 1)

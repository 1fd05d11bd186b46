"""Deterministic shuffles, folds, holdouts and samples.

All of them order rows by md5(seed:id). That order depends on neither the
partitioning nor the input order, and every retry repeats it. The exact rank is
computed in steps: the leading hex digits cut each stratum into 16.7 million
buckets of equal expected size, running counts give the offset of each bucket, in
two levels so that no window holds more than 4,096 of them, and rows are numbered
inside their bucket. No task ever sorts a whole stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, Labels
from ..functions.labels import group_id, is_negative, is_original, is_variant, role, trains
from ..functions.text import hash_number, keyed_hash
from .checks import assert_no_leakage
from .joins import required, skew_join

LEVEL = 3  # hex digits per level of buckets


def keyed_rank(
    df: DataFrame,
    id_col: str,
    seed: Column,
    strata: list[str],
    outer: list[str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Add `rank` (1-based within the strata) and `n` (stratum size).

    Null strata are strata of their own; a null id is an error. `outer` names the
    leading strata columns inside which strata follow each other in one
    numbering; then `before` holds the rows of earlier strata. With `top`,
    buckets that start beyond that rank are skipped unsorted.
    """
    keyed = required(df, id_col).withColumn("_key", keyed_hash(seed, F.col(id_col)))
    keyed = keyed.withColumns({"_high": F.substring("_key", 1, LEVEL), "_low": F.substring("_key", 1 + LEVEL, LEVEL)})
    fine = keyed.groupBy(*strata, "_high", "_low").agg(F.count(F.lit(1)).alias("_rows"))
    coarse = fine.groupBy(*strata, "_high").agg(F.sum("_rows").alias("_rows"))
    # At most 4,096 rows to a window on either level.
    within = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    earlier = [Window.unboundedPreceding, -1]
    starts = coarse.select(
        *strata,
        "_high",
        F.coalesce(F.sum("_rows").over(within.orderBy("_high").rowsBetween(*earlier)), F.lit(0)).alias("_start"),
        F.sum("_rows").over(within).alias("n"),
    )
    if outer is not None:
        inner = [s for s in strata if s not in outer]
        sizes = starts.select(*strata, "n").distinct()
        before = Window.partitionBy(*outer).orderBy(*inner).rowsBetween(*earlier)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        starts = _join_null_safe(starts, sizes, strata)
    inside = Window.partitionBy(*strata, "_high").orderBy("_low").rowsBetween(*earlier)
    offsets = fine.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).drop("_rows")
    offsets = _join_null_safe(offsets, starts, [*strata, "_high"])
    offsets = offsets.withColumn("_start", F.col("_start") + F.col("_inside")).drop("_inside")
    if top is not None:
        offsets = offsets.filter(F.col("_start") < top)
    place = [*strata, "_high", "_low"]
    in_bucket = Window.partitionBy(*place).orderBy("_key", id_col)
    ranked = (
        _join_null_safe(keyed, offsets, place)
        .withColumn("rank", F.row_number().over(in_bucket) + F.col("_start"))
        .drop("_key", "_high", "_low", "_start")
    )
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on])
    return left.join(other, same).drop(*[f"_of_{c}" for c in on])


def group_kfold(groups: DataFrame, seeds: list[int], k: int = 5) -> DataFrame:
    """(seed, group_id, y, fold): folds of equal class mix, a family in one fold.

    Classes are dealt out one after the other, so fold sizes differ by at most
    one per class and overall. Fewer than `k` groups in a class is an error.
    """
    every = groups.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), "group_id", "y")
    ranked = keyed_rank(every, "group_id", F.col("seed"), ["seed", "y"], outer=["seed"])
    position = F.col("rank") - 1 + F.col("before")
    too_few = F.raise_error(F.format_string(f"class %d has %d groups, fewer than {k} folds", "y", "n"))
    return ranked.select(
        "seed",
        "group_id",
        "y",
        F.when(F.col("n") < k, too_few.cast("int")).otherwise((position % k + 1).cast("int")).alias("fold"),
    )


def fold_rows(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every row with the fold that tests it, once per seed.

    `messages` carries group_id and y; a family may be of any size.
    """
    folds = assignments.groupBy("group_id").agg(
        # One entry per seed of the run: its length is the number of seeds.
        F.sort_array(F.collect_list(F.struct("seed", "fold"))).alias("_folds")
    )
    joined = skew_join(messages, folds, ["group_id"], ["msg_id"])
    return joined.withColumn("_f", F.explode("_folds")).select(
        *[c for c in messages.columns if c not in ("seed", "fold")], "_f.seed", "_f.fold"
    )


def fold_columns(messages: DataFrame, assignments: DataFrame, seeds: list[int]) -> DataFrame:
    """Every row once, with its test fold per seed in columns fold_<seed>.

    Training and test sides are then plain filters, without joins or copies.
    """
    wide = assignments.groupBy("group_id").agg(
        *[F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(f"fold_{s}") for s in seeds]
    )
    return skew_join(messages, wide, ["group_id"], ["msg_id"])


def fold_train_rows(rows: DataFrame, k: int = 5, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Training side in long form: a training row once per fold not testing it."""
    others = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda f: f != F.col("_test"))
    return (
        rows.filter(trains(labels))
        .withColumnRenamed("fold", "_test")
        .withColumn("fold", F.explode(others))
        .drop("_test")
    )


def fold_sizes(rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Groups and rows on both sides of each fold, from one pass over the rows."""
    per_group = rows.groupBy("seed", "fold", "group_id").agg(
        F.count_if(trains(labels)).alias("train"),
        F.count_if(is_negative(labels)).alias("neg"),
        F.count_if(is_original(labels)).alias("orig"),
        F.count_if(is_variant(labels)).alias("variant"),
    )
    per_fold = per_group.groupBy("seed", "fold").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("train").alias("train"),
        (F.sum("neg") + F.sum("orig")).alias("n_testA_rows"),
        (F.sum("neg") + F.sum("variant")).alias("n_testB_rows"),
    )
    seed = Window.partitionBy("seed")
    return per_fold.select(
        "seed",
        "fold",
        (F.sum("groups").over(seed) - F.col("groups")).alias("n_groups_train"),
        F.col("groups").alias("n_groups_test"),
        (F.sum("train").over(seed) - F.col("train")).alias("n_train_rows"),
        "n_testA_rows",
        "n_testB_rows",
    )


def holdout_sides(messages: DataFrame, seed: int, ratio: float = 0.2, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(family_id, kind, side): originals and negatives, each cut at `ratio`.

    At least one of each goes to test; the count rounds half to even. Rows
    without an id are left out, and an id that comes twice counts once.
    """
    units = messages.filter((is_original(labels) | is_negative(labels)) & F.col("msg_id").isNotNull()).select(
        F.col("msg_id").alias("family_id"), role(labels).alias("kind")
    )
    units = units.distinct()
    ranked = keyed_rank(units, "family_id", F.lit(seed), ["kind"])
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("bigint"))
    return ranked.select(
        "family_id", "kind", F.when(F.col("rank") <= n_test, "test").otherwise("train").alias("side")
    )


def apply_sides(messages: DataFrame, sides: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rows by `split`: train, test_original, test_paraphrase.

    Train holds no variants; test_paraphrase holds the variants of test
    families; the test negatives are in both test splits. A variant without a
    base id is an error; rows that `sides` does not know are left out.
    """
    kind = F.when(is_variant(labels), F.lit("positive_original")).otherwise(role(labels))
    family = group_id(labels)
    member = messages.withColumns({"family_id": family, "kind": kind})
    joined = skew_join(member, sides, ["family_id", "kind"], ["msg_id"])
    test = F.col("side") == "test"
    splits = F.array(
        F.when(~test & ~is_variant(labels), F.lit("train")),
        F.when(test & ~is_variant(labels), F.lit("test_original")),
        F.when(test & ~is_original(labels), F.lit("test_paraphrase")),
    )
    return (
        joined.withColumn("split", F.explode(F.filter(splits, lambda s: s.isNotNull())))
        .drop("kind", "side")
    )


def holdout_split(
    messages: DataFrame, seed: int, ratio: float = 0.2, labels: Labels = DEFAULT_LABELS, check: bool = True
) -> DataFrame:
    """Rows by `split`; with `check`, leakage between the sides is an error at once."""
    rows = apply_sides(messages, holdout_sides(messages, seed, ratio, labels), labels)
    if check:
        assert_no_leakage(rows, labels)
    return rows


def train_val_split(
    rows: DataFrame,
    seed: int,
    ratio: float = 0.2,
    strata: list[str] | None = None,
    within: list[str] | None = None,
    id_col: str = "msg_id",
) -> DataFrame:
    """Add `part`: `val` or `train`.

    The validation side has the ceiling of `ratio` times all rows, at least one.
    With `strata`, that many places are allotted to the strata by their exact
    shares: the whole parts first, the places left over by largest remainder,
    ties by stratum size, then name. `within` names columns, a fold for
    instance, each of whose values is a split of its own.
    """
    strata, within = strata or [], within or []
    ranked = keyed_rank(rows, id_col, F.lit(seed), [*within, *strata])
    # Ratios are exact to nine digits, so that no rounding of doubles adds a place.
    part = F.round(F.lit(ratio), 9).cast("decimal(10,9)")

    def places_of(n: Column) -> Column:
        return F.greatest(F.ceil(n.cast("decimal(20,0)") * part).cast("bigint"), F.lit(1))

    if strata:
        sizes = rows.groupBy(*within, *strata).agg(F.count(F.lit(1)).alias("_size"))
        group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
        sizes = sizes.withColumn("_total", F.sum("_size").over(group)).withColumn("_wanted", places_of(F.col("_total")))
        share = F.col("_wanted") * F.col("_size")
        sizes = sizes.withColumns({"_whole": F.floor(share / F.col("_total")), "_rest": share % F.col("_total")})
        order = F.row_number().over(group.orderBy(F.desc("_rest"), F.desc("_size"), *strata))
        left_over = F.col("_wanted") - F.sum("_whole").over(group)
        # As many rows as there are strata.
        places = sizes.select(*within, *strata, (F.col("_whole") + (order <= left_over).cast("int")).alias("_places"))
        ranked = _join_null_safe(ranked, places, [*within, *strata])
    else:
        ranked = ranked.withColumn("_places", places_of(F.col("n")))
    part_of = F.when(F.col("rank") <= F.col("_places"), "val").otherwise("train")
    return ranked.withColumn("part", part_of).drop("rank", "n", "_places")


def capped_sample(rows: DataFrame, n: int, seed: int, strata: list[str], id_col: str = "msg_id") -> DataFrame:
    """A random `n` rows per stratum, all when there are fewer; 0 turns it off."""
    if n <= 0:
        return rows
    return keyed_rank(rows, id_col, F.lit(seed), strata, top=n).drop("rank", "n")


def balanced_resample(rows: DataFrame, seed: int, class_col: str = "y", id_col: str = "msg_id") -> DataFrame:
    """Weighted sampling with replacement: as many draws as rows, classes level.

    Each row makes one draw, fixed by its hash: first a class, each equally
    likely, then a rank within it. Draws are counted per (class, rank) before
    they meet the rows, so a rare class drawn over and over is one row. The
    result holds the drawn rows with `n_draws`, how often each came up.
    """
    ranked = keyed_rank(rows, id_col, F.lit(seed), [class_col])
    classes = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("_size"))
    numbered = classes.select(
        F.col(class_col),
        F.col("_size"),
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(class_col)) - 1).alias("_no"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_classes"),
    )
    digest = keyed_hash(F.lit(f"draw{seed}"), F.col(id_col))
    n_classes = numbered.agg(F.max("_classes")).scalar()
    draws = rows.select(
        (hash_number(F.substring(digest, 18, 15)) % n_classes).cast("int").alias("_no"),
        hash_number(digest).alias("_u"),
    )
    # As many rows as there are classes.
    counted = (
        draws.join(F.broadcast(numbered), "_no")
        .select(F.col(class_col), (F.col("_u") % F.col("_size") + 1).alias("rank"))
        .groupBy(class_col, "rank")
        .agg(F.count(F.lit(1)).alias("n_draws"))
    )
    return ranked.join(counted, [class_col, "rank"]).drop("rank", "n")

"""Split manifest, dataset manifest and nested experiment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_LABELS, MAX_WORDS, MIN_WORDS, Labels
from ..functions.labels import is_negative, is_original, is_variant
from ..operators.metrics import length_stats, value_counts

ID_LISTS = ("train_phish_base_ids", "test_phish_base_ids", "train_legit_ids", "test_legit_ids")


def list_name(labels: Labels = DEFAULT_LABELS) -> Column:
    """Which id list of the manifest a (kind, side) row belongs to."""
    suffix = F.when(F.col("kind") == "negative", f"{labels.negative}_ids").otherwise(f"{labels.positive}_base_ids")
    return F.concat_ws("_", F.col("side"), suffix)


def split_counts(messages: DataFrame, split_rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(name, n): three totals of the dataset and three of the splits."""
    totals = messages.agg(
        F.count_if(is_original(labels)).alias(f"{labels.positive}_original_total"),
        F.count_if(is_variant(labels)).alias(f"{labels.positive}_paraphrase_total"),
        F.count_if(is_negative(labels)).alias(f"{labels.negative}_total"),
    )
    parts = split_rows.agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_total") for s in ("train", "test_original", "test_paraphrase")]
    )

    def long(df: DataFrame) -> DataFrame:
        return df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns]))
        )

    return long(totals).unionByName(long(parts))


def split_manifest(
    messages: DataFrame,
    sides: DataFrame,
    split_rows: DataFrame,
    labels: Labels = DEFAULT_LABELS,
    dataset: str = "",
    seed: int | None = None,
    test_ratio: float | None = None,
) -> DataFrame:
    """(section, name, value): the settings of the split where given, the counts, and
    every id of the four id lists.

    Long form: a list in one field would not hold the ids of a large corpus.
    """
    given = {"dataset": dataset or None, "seed": seed, "test_ratio": test_ratio}
    pairs = [(n, str(v)) for n, v in given.items() if v is not None]
    header = messages.sparkSession.createDataFrame(
        [("settings", n, v) for n, v in pairs], "section string, name string, value string"
    )
    counts = split_counts(messages, split_rows, labels).select(
        F.lit("counts").alias("section"), "name", F.col("n").cast("string").alias("value")
    )
    ids = sides.select(F.lit("ids").alias("section"), list_name(labels).alias("name"), F.col("family_id").alias("value"))
    return header.unionByName(counts).unionByName(ids)


def write_split_manifest(manifest: DataFrame, path: str) -> None:
    """Sorted rows as JSON Lines, one folder per section and list."""
    manifest.repartitionByRange("section", "name", "value").sortWithinPartitions(
        "section", "name", "value"
    ).write.mode("overwrite").partitionBy("section", "name").json(path)


def split_document(manifest: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row: the manifest as a nested record with sorted id lists, for tools that
    read a single document. Beyond `most` ids, which one row should not hold, it
    is an error; the long form has no such bound."""
    n = manifest.filter("section = 'ids'").limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} ids: use the long form")

    def value(section: str, name: str, kind: str) -> Column:
        of = (F.col("section") == section) & (F.col("name") == name)
        return F.max(F.when(of, F.col("value"))).cast(kind).alias(name)

    def listed(name: str) -> Column:
        of = (F.col("section") == "ids") & (F.col("name") == name)
        return F.sort_array(F.collect_list(F.when(of, F.col("value")))).alias(name)

    names = [r[0] for r in manifest.filter("section = 'counts'").select("name").distinct().orderBy("name").collect()]
    settings = {"dataset": "string", "seed": "bigint", "test_ratio": "double"}
    return manifest.agg(
        *[value("settings", n, kind) for n, kind in settings.items()],
        F.struct(*[value("counts", n, "bigint") for n in names]).alias("counts"),
        F.struct(*[listed(n) for n in ID_LISTS]).alias("splits"),
    )


def write_split_document(manifest: DataFrame, path: str) -> None:
    split_document(manifest).write.mode("overwrite").json(path)


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(family_id, kind, side) from a manifest written by `write_split_manifest`."""
    rows = spark.read.schema("section string, name string, value string").json(path)
    return sides_from_lists(rows.filter("section = 'ids'"))


def sides_from_lists(ids: DataFrame) -> DataFrame:
    """(name, value) id rows -> (family_id, kind, side)."""
    return ids.select(
        F.col("value").alias("family_id"),
        F.when(F.col("name").endswith("base_ids"), "positive_original").otherwise("negative").alias("kind"),
        F.substring_index("name", "_", 1).alias("side"),
    )


def read_split_document(spark: SparkSession, path: str) -> DataFrame:
    """The same from a single JSON document with the four lists as arrays."""
    lists = ", ".join(f"{n}: array<string>" for n in ID_LISTS)
    doc = spark.read.schema(f"splits struct<{lists}>").option("multiLine", "true").json(path)
    entries = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(f"splits.{n}").alias("ids")) for n in ID_LISTS]
    )
    return sides_from_lists(doc.select(F.inline(entries)).select("name", F.explode("ids").alias("value")))


def dataset_manifest(messages: DataFrame, settings: dict[str, str] | None = None, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """(section, key, value) rows: total, counts, length statistics, settings."""
    counts = value_counts(messages, labels).select(
        F.concat(F.lit("count_"), F.col("section")).alias("section"),
        F.col("value").alias("key"),
        F.col("n").cast("string").alias("value"),
    )
    names = ("n", "min", "p25", "median", "p75", "max")
    stats = length_stats(messages, labels=labels)
    lengths = stats.select(
        F.concat(F.lit("length_"), F.col("section")).alias("section"),
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names],
                F.struct(F.lit("mean").alias("key"), F.format_string("%.6f", "mean").alias("value")),
            )
        ),
    )
    fixed = {"word_bounds": f"{MIN_WORDS}-{MAX_WORDS}", "deduplication": "sha256 of normalized text", **(settings or {})}
    pairs = [F.lit(v) for item in fixed.items() for v in item]
    config = (
        messages.sparkSession.range(1)
        .select(F.explode(F.create_map(*pairs)).alias("key", "value"))
        .select(F.lit("settings").alias("section"), "key", "value")
    )
    return counts.unionByName(lengths).unionByName(config)


def manifest_markdown(manifest: DataFrame) -> str:
    """The report as text. Reads a few dozen rows: names and numbers only."""
    rows = sorted((r.section, r.key, r.value) for r in manifest.collect())
    lines = ["# Dataset manifest"]
    for section in dict.fromkeys(r[0] for r in rows):
        lines += ["", f"## {section}", ""]
        lines += [f"- {key}: {value}" for s, key, value in rows if s == section]
    return "\n".join(lines) + "\n"


# Names of the sizes of a fold in its record.
SIZES = ("n_groups_train", "n_groups_test", "n_train_rows", "n_testA_rows", "n_testB_rows")


def metrics_record(
    metrics: DataFrame,
    folds: DataFrame,
    summary: DataFrame,
    model: str,
    sizes: DataFrame | None = None,
    settings: dict[str, str] | None = None,
) -> DataFrame:
    """(seed, record): one nested experiment record per seed.

    The fold list has one entry per fold of the run, with the columns of `sizes`
    (one row per seed and fold); `settings` are what the run was given, dataset,
    grouping and training rule for instance.
    """
    if sizes is not None:
        folds = folds.join(sizes, ["seed", "fold"])
    counts = [c for c in SIZES if c in folds.columns]
    cell = F.struct("accuracy", "precision", "recall", "f1", _matrix().alias("confusion_matrix"))
    per_fold = metrics.groupBy("seed", "fold").agg(
        *[F.max(F.when(F.col("cond") == c, cell)).alias(f"condition_{c}") for c in ("A", "B")]
    )
    fold = F.struct("fold", *counts, "condition_A", "condition_B", "delta_f1", "delta_recall")
    fold_list = (
        per_fold.join(folds.select("seed", "fold", *counts, "delta_f1", "delta_recall"), ["seed", "fold"])
        .groupBy("seed")
        .agg(F.sort_array(F.collect_list(fold)).alias("fold_results"), F.count(F.lit(1)).alias("folds"))
    )
    aggregate = summary.groupBy("seed").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("mean", "std"))))).alias("aggregate")
    )
    given = [F.lit(v).alias(n) for n, v in (settings or {}).items()]
    body = F.struct(F.lit(model).alias("model"), *given, "seed", "folds", "aggregate", "fold_results")
    return fold_list.join(aggregate, "seed").select("seed", body.alias("record"))


def _matrix() -> Column:
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def sweep_values(records: DataFrame, paths: list[str]) -> DataFrame:
    """(seed, path, value) at caller-chosen paths of (seed, record) rows, all seeds in one job."""
    as_json = records.select("seed", F.to_json("record").alias("_j"))
    found = [F.struct(F.lit(p).alias("path"), dot_path(F.col("_j"), p).cast("double").alias("value")) for p in paths]
    return as_json.select("seed", F.inline(F.array(*found)))


def sweep_record(values: DataFrame, model: str, folds: int) -> DataFrame:
    """One row: the summary record of a sweep, a row of values per seed."""
    per_seed = values.groupBy("seed").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "value")))).alias("values")
    )
    return per_seed.agg(
        F.lit(model).alias("model"),
        F.lit(folds).alias("folds"),
        F.sort_array(F.collect_list("seed")).alias("seeds"),
        F.sort_array(F.collect_list(F.struct("seed", F.to_json("values").alias("values")))).alias("rows"),
    )


def dot_path(record_json: Column, path: str) -> Column:
    """Value at a.b.c of a JSON record; a missing key is an error naming the path."""
    value = F.get_json_object(record_json, "$." + path)
    return F.coalesce(value, F.raise_error(F.lit(f"no value at {path}")).cast("string"))

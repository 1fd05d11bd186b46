"""Message-shaped views over the driver's tables.

`messages` gives every document a place in a family (structure only: the label
says nothing about the text); `labelled_messages` takes real labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NEGATIVE_SCENARIO, NO_STRATEGY, SCENARIOS, STRATEGIES
from ..functions.ids import legit_id, phish_id
from ..functions.text import compute_once, hash_score, normalize_text, text_hash, word_count
from ..operators.dedup import SOURCE_STRIDE
from ..operators.joins import skew_join

FAMILY = 7  # an original, five variants, a negative


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of fewer splits than cores one partition per core, so that
    text work on a small file is parallel. Larger inputs pass untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as messages: 1 original : 5 variants : 1 negative by id."""
    block = F.expr(f"doc_id DIV {FAMILY}")
    place = F.col("doc_id") % FAMILY
    scenario = F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (block % len(SCENARIOS) + 1).cast("int"))
    negative = place == FAMILY - 1
    variant = place.between(1, FAMILY - 2)
    code = F.when(place == 0, "orig").otherwise(F.concat(F.lit("p"), place.cast("string")))
    rank = F.when(negative, 2).when(variant, 1).otherwise(0)
    strategy: Column = F.lit(NO_STRATEGY)
    for position, name in enumerate(STRATEGIES.values(), start=1):
        strategy = F.when(place == position, name).otherwise(strategy)
    return documents(spark, folder).select(
        F.when(negative, legit_id(block)).otherwise(phish_id(scenario, block, code)).alias("msg_id"),
        F.when(negative, "legit").otherwise("phish").alias("label"),
        F.when(negative, NEGATIVE_SCENARIO).otherwise(scenario).alias("scenario"),
        F.when(variant, "paraphrase").otherwise("original").alias("variant_type"),
        strategy.alias("paraphrase_strategy"),
        F.when(variant, phish_id(scenario, block, F.lit("orig"))).alias("base_msg_id"),
        F.when(negative, "synthetic_legit").otherwise("generated_llm").alias("source"),
        "text",
        "doc_id",
        (rank.cast("bigint") * SOURCE_STRIDE + F.col("doc_id")).alias("ord"),
    )


def cleaned(df: DataFrame) -> DataFrame:
    """Normalized text with its word count and hash."""
    return compute_once(df, text=normalize_text(F.col("text"))).withColumns(
        {"length_words": word_count(F.col("text")), "text_hash": text_hash(F.col("text"))}
    )


def labelled_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: quality 1 is positive; the first positive copy of a text
    is the original, later ones are its variants. All copies of a text, of either
    class, are one family (`family_id`), so that no text meets itself across a fold."""
    docs = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    clean = compute_once(docs, text=normalize_text(F.col("text")))
    hashed = clean.select(
        "doc_id",
        "text",
        F.when(F.col("quality") == 1, "phish").otherwise("legit").alias("label"),
        text_hash(F.col("text")).alias("text_hash"),
    )
    # One row per text, from partial minima; copies find it by hash.
    positive = F.when(F.col("label") == "phish", F.col("doc_id"))
    firsts = hashed.groupBy("text_hash").agg(F.min(positive).alias("first_id"), F.min("doc_id").alias("family_id"))
    joined = skew_join(hashed, firsts, ["text_hash"], ["doc_id"], how="left")
    copy = (F.col("label") == "phish") & (F.col("doc_id") > F.col("first_id"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return joined.select(
        name.alias("msg_id"),
        "label",
        F.when(copy, "paraphrase").otherwise("original").alias("variant_type"),
        F.when(copy, F.concat(F.lit("doc_"), F.col("first_id").cast("string"))).alias("base_msg_id"),
        "text",
        "text_hash",
        F.concat(F.lit("text_"), F.col("family_id").cast("string")).alias("family_id"),
        "doc_id",
    )


def predictions(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """(seed, msg_id, score): a score per message and seed, fixed by its hash."""
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    return rows.select("msg_id", seed).withColumn("score", hash_score(F.col("seed"), F.col("msg_id")))


def votes(rows: DataFrame, n_votes: int = 3) -> DataFrame:
    """(msg_id, vote, label, confidence): several answers per message."""
    number = F.explode(F.sequence(F.lit(0), F.lit(n_votes - 1))).alias("vote")
    scored = rows.select("msg_id", number).withColumn("score", hash_score(F.col("msg_id"), F.col("vote")))
    return scored.select(
        "msg_id",
        "vote",
        F.when(F.col("score") >= 0.5, "phish").otherwise("legit").alias("label"),
        F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"),
    )

"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before it kept, written as Parquet and read again,
so a lost executor costs a stage's tasks at most. All stages but the last return
the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import hamming, language, packing, radix, suffix
from kinfold.llm.vocabularies import tokenizer
from kinfold.session import materialize

SIMILAR = 80  # hundredths of the five-word shingles that near-duplicates share

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without text or without
    letters go. The model learns from the documents that have a language; with none
    there to learn from, all documents with letters stay."""
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # A text travels once: beside the other columns, not among them as well.
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc"), docs["text"].alias("body"))
    found = language.identify(rows, model, "doc", "body", keep_text=True)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select("id.*", "text").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the smallest doc_id."""
    groups = radix.exact_groups(docs, carry=docs.columns)
    return groups.filter("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, similar by SIMILAR or more, the row of the smallest doc_id.
    Rows are told apart by doc_id and text, should an id come twice."""
    known = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("h")))
    kept = hamming.near_classes(known, "_row", similar=SIMILAR).filter("kept").select(F.col("id").alias("_row"))
    return known.join(kept, "_row", "left_semi").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too. Characters of which a
    part went go as a whole, null texts become empty; every document stays."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*rest).alias("doc"), docs["text"].alias("body"))
    cut = suffix.repeated_spans(rows, "doc", "body", as_text=True)
    out = cut.select("id.*", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.piece_columns(packing.pack(docs, tokenizer("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

# Signatures, language models and token ids have no SQL form; tests/llm compares
# the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

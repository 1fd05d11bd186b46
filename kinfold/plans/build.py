"""Dataset building: clean, gate, deduplicate, log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUILD_RULES, DEFAULT_LABELS, DUPLICATE, OK, GateRules, Labels
from ..functions.gate import gate_reason
from ..functions.ids import id_variant
from ..functions.labels import is_variant
from ..functions.text import compute_once, normalize_text, preview, text_hash, word_count
from ..operators.dedup import backfill, dedup_first
from ..operators.joins import first_uses, required
from ..session import new_path

# What a log event says of its message, null where the messages lack the column.
LOG_FIELDS = {"scenario": "string", "base_msg_id": "string", "paraphrase_strategy": "string", "attempt": "int"}


@dataclass(frozen=True)
class Gated:
    """`scratch` is the written table that both read; `session.release` removes it."""

    accepted: DataFrame
    rejected: DataFrame
    scratch: str


def score_gate(messages: DataFrame, rules: GateRules = BUILD_RULES, finish: str | None = None) -> DataFrame:
    """Normalized text, its counts and hash, and the gate's `reason`."""
    clean = compute_once(messages, text=normalize_text(F.col("text")))
    counted = compute_once(clean, length_words=word_count(F.col("text")))
    finish_reason = F.col(finish) if finish else None
    reason = gate_reason(F.col("text"), F.col("length_words"), rules, finish_reason)
    return compute_once(counted, reason=reason).withColumn("text_hash", text_hash(F.col("text")))


def gate_and_dedup(
    messages: DataFrame,
    known: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    rules: GateRules = BUILD_RULES,
    finish: str | None = None,
) -> Gated:
    """Accepted rows, and the log of the others.

    Texts are cleaned, counted and hashed once; the scored rows are written, and
    what follows reads the columns it needs. Accepted: passes the gate, first of
    its text, text not in `known`; whole rows are shuffled once, after the copies
    were merged map-side. Rejected: whatever did not win, found by `ord`, so copies
    of one text are spread over all tasks. A row without `ord` is an error.
    `known` may be a function of the rows that pass, to look up theirs only.
    """
    spark = messages.sparkSession
    path = new_path(spark, "gate")
    scored = required(score_gate(messages, rules, finish), "ord")
    scored.write.parquet(path)
    scored = spark.read.schema(scored.schema).parquet(path)
    passed = scored.filter(F.col("reason") == OK)
    if callable(known):
        known = known(passed)
    accepted = dedup_first(passed)
    if known is not None:
        accepted = accepted.join(known.select("text_hash").distinct(), "text_hash", "left_anti")
    winners = first_uses(passed.select("text_hash", "ord"), known)
    rejected = (
        scored.select("msg_id", "ord", "reason", preview(F.col("text")).alias("preview"), *_log_fields(scored))
        .join(winners.select("ord"), "ord", "left_anti")
        .select(
            "msg_id",
            *LOG_FIELDS,
            F.when(F.col("reason") == OK, DUPLICATE).otherwise(F.col("reason")).alias("reason"),
            F.when(F.col("reason") != OK, F.col("preview")).alias("preview"),
        )
    )
    return Gated(accepted, rejected, path)


def _log_fields(df: DataFrame) -> list[Column]:
    have = {n: F.col(n).cast(kind) if n in df.columns else F.lit(None).cast(kind) for n, kind in LOG_FIELDS.items()}
    have["attempt"] = F.coalesce(have["attempt"], F.lit(1))
    return [c.alias(n) for n, c in have.items()]


def _event(stage: str) -> list:
    strategy = F.col("paraphrase_strategy").alias("strategy")
    return [F.lit(stage).alias("stage"), "scenario", "base_msg_id", "msg_id", strategy, "attempt"]


def _day(date: str | None) -> Column:
    return (F.lit(date).cast("date") if date else F.current_date()).alias("date")


def reject_log(gated: Gated, stage: str, date: str | None = None) -> DataFrame:
    """An event per rejected row: what it is, its reason, the number the reason
    speaks of as `detail`, and a preview; to be written by date and stage."""
    detail = F.nullif(F.regexp_extract("reason", r"\((\d+)\)", 1), F.lit("")).cast("int").alias("detail")
    return gated.rejected.select(*_event(stage), "reason", detail, "preview", _day(date))


def run_log(gated: Gated, stage: str, date: str | None = None) -> DataFrame:
    """An event per accepted row."""
    rest = [c for c in gated.accepted.columns if c not in LOG_FIELDS]
    rows = gated.accepted.select(*rest, *_log_fields(gated.accepted))
    return rows.select(*_event(stage), F.lit(OK).alias("status"), _day(date))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("date", "stage").parquet(path)


def finalize(merged: DataFrame) -> DataFrame:
    """Back-fill hashes and lengths, drop rows without text, keep the first copy."""
    return dedup_first(backfill(merged))


def with_provenance(
    messages: DataFrame,
    model: str,
    temperature: float,
    top_p: float,
    max_output_tokens: int,
    date: str | None = None,
    source: str = "generated_llm",
    negative_source: str = "synthetic_legit",
    version: str = "v1",
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Columns that say how a run made its messages. The prompt is named by scenario, or
    the negative label, and variant code, `base` for all but variants."""
    day = F.lit(date).cast("date") if date else F.current_date()
    negative = F.col("label") == labels.negative
    topic = F.when(negative, F.lit(labels.negative)).otherwise(F.col("scenario"))
    code = F.when(is_variant(labels), id_variant(F.col("msg_id"))).otherwise(F.lit("base"))
    return messages.withColumns(
        {
            "source": F.when(negative, F.lit(negative_source)).otherwise(F.lit(source)),
            "prompt_id": F.concat_ws("_", topic, code, F.lit(version)),
            "generation_model": F.lit(model),
            "temperature": F.lit(float(temperature)),
            "top_p": F.lit(float(top_p)),
            "max_output_tokens": F.lit(max_output_tokens),
            "date_generated": day,
        }
    )

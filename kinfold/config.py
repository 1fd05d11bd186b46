"""Message schema, label vocabulary and gate rules.

Every value here is a default: operators take the labels, rules and name lists
as parameters, so the same code serves any positive / negative message corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values: names, bounds and phrases a replayed run must agree on. ---
SCENARIOS = ("credential_theft", "impersonation", "invoice_fraud", "account_recovery")
NEGATIVE_SCENARIO = "legit_na"
NO_STRATEGY = "na"
STRATEGIES = {
    "p1": "professional_polish",
    "p2": "friendly_tone",
    "p3": "reduced_urgency",
    "p4": "structural_rewrite",
    "p5": "remove_suspicious_keywords",
}
SCENARIO_TARGET = 30
NEGATIVE_TARGET = 120
MIN_WORDS = 120
MAX_WORDS = 200
TRUNCATED_SUFFIX = "MAX_TOKENS"
# --- end of fixed values ---

DUPLICATE = "duplicate_hash"
OK = "ok"

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("msg_id", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("scenario", T.StringType()),
        T.StructField("variant_type", T.StringType()),
        T.StructField("paraphrase_strategy", T.StringType()),
        T.StructField("base_msg_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("generation_model", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("max_output_tokens", T.IntegerType()),
        T.StructField("prompt_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("length_words", T.IntegerType()),
        T.StructField("text_hash", T.StringType()),
        T.StructField("date_generated", T.DateType()),
        # Files have no row order in Spark, and keep-first needs one.
        T.StructField("ord", T.LongType()),
    ]
)

REQUIRED_COLUMNS = ("msg_id", "label", "variant_type", "text")


@dataclass(frozen=True)
class Labels:
    """Names of the two classes and of the two kinds of positive message."""

    positive: str = "phish"
    negative: str = "legit"
    original: str = "original"
    variant: str = "paraphrase"


@dataclass(frozen=True)
class PhraseRule:
    """Reject with `reason` when, for any group, the text holds all its phrases."""

    reason: str
    any_of: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class GateRules:
    min_words: int = MIN_WORDS
    max_words: int = MAX_WORDS
    phrases: tuple[PhraseRule, ...] = field(default_factory=tuple)


# The two phrase profiles. The build profile is the strict one;
# the fill profile (used when topping up missing variants) knows one phrase.
BUILD_RULES = GateRules(
    phrases=(
        PhraseRule("meta_or_refusal", (("as an ai",), ("i can't", "email"))),
        PhraseRule("meta_simulation", (("this is a simulation",), ("for research",))),
    )
)
FILL_RULES = GateRules(phrases=(PhraseRule("meta", (("as an ai",),)),))

DEFAULT_LABELS = Labels()

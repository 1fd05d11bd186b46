"""Sixteen numeric features of a message, each a JVM-side expression."""

from __future__ import annotations

import re
import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NON_SPACE, SPACE, strip

# --- Fixed values: patterns and words that define the features. ---
URL = rf"(?iU)(https?://{NON_SPACE}+|www\.{NON_SPACE}+)"
EMAIL = r"(?iU)\b[\w\.-]+@[\w\.-]+\.\w+\b"
PHONE = r"(?U)(\+\d{1,3}[\s\x1c-\x1f-]?)?(\(?\d{2,4}\)?[\s\x1c-\x1f-]?)?\d{3,4}[\s\x1c-\x1f-]?\d{3,4}"
MONEY = rf"(?iU)(\$|€|£){SPACE}?\d+|\b\d+{SPACE}?(usd|eur|gbp)\b"
PUNCTUATION = ".,;:!?()[]{}<>\"'"
KEYWORDS = (
    "invoice", "payment", "billing", "vendor", "bank", "wire",
    "account", "password", "login", "verify", "verification", "credentials",
    "security", "compliance", "attestation", "portal", "recover", "recovery",
    "urgent", "immediately", "asap", "action required",
)
FEATURES = (
    "n_chars", "n_words", "n_lines", "avg_word_len", "caps_ratio", "digit_ratio",
    "punct_ratio", "exclam", "question", "n_urls", "n_emails", "n_phones",
    "n_money", "kw_hits", "has_url", "has_http",
)
# --- end of fixed values ---


@cache
def _digit_signs() -> str:
    """Digits that are not decimals: superscripts, circled numbers and the like."""
    return "".join(chr(c) for c in range(128, sys.maxunicode) if chr(c).isdigit() and not chr(c).isdecimal())


def _chars_removed(text: Column, pattern: str) -> Column:
    """How many characters the pattern covers; one pass, no match list."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _count_if_any(possible: Column, text: Column, pattern: str) -> Column:
    """Matches of a costly pattern, which is tried only where it can match."""
    return F.when(possible, F.regexp_count(text, F.lit(pattern))).otherwise(0)


def numeric_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of FEATURES (doubles). Text is used whole, stripped."""
    s, low = F.col("_s"), F.col("_low")
    counted = df.withColumn("_s", strip(F.coalesce(F.col(text), F.lit("")))).select(
        "*",
        F.length(s).alias("_chars"),
        F.regexp_count(s, F.lit(f"(?U){NON_SPACE}+")).alias("_words"),
        _chars_removed(s, f"(?U){SPACE}+").alias("_blank"),
        _chars_removed(s, r"\p{IsUppercase}+").alias("_upper"),
        _chars_removed(s, r"\p{IsLowercase}+").alias("_lower"),
        _chars_removed(s, r"\p{Nd}+").alias("_decimals"),
        F.when(F.length(s) == F.octet_length(s), 0)
        .otherwise(F.length(s) - F.length(F.translate(s, _digit_signs(), "")))
        .alias("_signs"),
        _chars_removed(s, "[" + re.escape(PUNCTUATION) + "]+").alias("_punct"),
        F.lower(s).alias("_low"),
    )
    linked = counted.withColumn(
        "_urls", _count_if_any(F.contains(low, F.lit("http")) | F.contains(low, F.lit("www.")), s, URL)
    )
    chars = F.greatest(F.col("_chars"), F.lit(1))
    letters = F.greatest(F.col("_upper") + F.col("_lower"), F.lit(1))
    has_digit = F.col("_decimals") > 0
    hits = sum((F.contains(low, F.lit(k)).cast("int") for k in KEYWORDS), F.lit(0))
    values = {
        "n_chars": F.col("_chars"),
        "n_words": F.col("_words"),
        "n_lines": F.when(F.col("_chars") == 0, 0).otherwise(_count_char(s, "\n") + 1),
        "avg_word_len": F.when(F.col("_words") == 0, 0.0).otherwise(
            (F.col("_chars") - F.col("_blank")) / F.greatest(F.col("_words"), F.lit(1))
        ),
        "caps_ratio": F.col("_upper") / letters,
        "digit_ratio": (F.col("_decimals") + F.col("_signs")) / chars,
        "punct_ratio": F.col("_punct") / chars,
        "exclam": _count_char(s, "!"),
        "question": _count_char(s, "?"),
        "n_urls": F.col("_urls"),
        "n_emails": _count_if_any(F.contains(s, F.lit("@")), s, EMAIL),
        "n_phones": _count_if_any(has_digit, s, PHONE),
        "n_money": _count_if_any(has_digit, s, MONEY),
        "kw_hits": hits,
        "has_url": (F.col("_urls") > 0).cast("int"),
        "has_http": F.contains(low, F.lit("http")).cast("int"),
    }
    return linked.select(
        *[F.col(c) for c in df.columns], *[values[n].cast("double").alias(n) for n in FEATURES]
    )

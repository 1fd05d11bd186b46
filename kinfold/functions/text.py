"""Cleaning, counting and hashing of message text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (Unicode White_Space
# plus the four ASCII separators). Java's Unicode \s lacks only the latter.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """LF line ends, single blanks, at most one empty line, no outer space."""
    t = F.coalesce(text, F.lit(""))
    t = F.replace(t, F.lit("\r\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\r"), F.lit("\n"))
    # Only real runs are rewritten; a lone blank is already normal.
    t = F.regexp_replace(t, "[ \t]{2,}|\t", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(t)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){NON_SPACE}+"))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def preview(text: Column, chars: int = 200) -> Column:
    return F.left(text, F.lit(chars))


def cache_key(text: Column, model: str, prompt_version: str) -> Column:
    return F.concat_ws("|", F.lit(model), F.lit(prompt_version), text_hash(text))


def keyed_hash(seed: Column, key: Column) -> Column:
    """32 hex digits that order rows the same way on every engine and layout."""
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def hash_number(hex_digest: Column, digits: int = 15) -> Column:
    """The leading hex digits as a non-negative bigint (15 digits fit 60 bits)."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("bigint")


def hash_score(seed: Column, key: Column) -> Column:
    """Uniform number in [0, 1) with 32 bits, fixed by (seed, key)."""
    return hash_number(keyed_hash(seed, key), 8) / F.lit(4294967296.0)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are costly and used more than once.

    As generator output they are computed where they stand. A plain projection
    would be copied into every filter that Catalyst pushes below it.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(
        *df.columns, *[n for n in columns if n not in df.columns]
    )

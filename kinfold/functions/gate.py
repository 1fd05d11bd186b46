"""Quality gate: one CASE chain, the first failing rule names the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUILD_RULES, OK, TRUNCATED_SUFFIX, GateRules, PhraseRule


def _has_phrases(lowered: Column, rule: PhraseRule) -> Column:
    groups = [
        reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(p)) for p in group])
        for group in rule.any_of
    ]
    return reduce(lambda a, b: a | b, groups)


def gate_reason(
    text: Column,
    words: Column,
    rules: GateRules = BUILD_RULES,
    finish_reason: Column | None = None,
) -> Column:
    """'ok' or the reject reason of normalized `text` holding `words` words.

    With `finish_reason`, a cut-off answer is rejected before anything else.
    """
    chain = F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
    if finish_reason is not None:
        cut = F.endswith(F.coalesce(finish_reason, F.lit("")), F.lit(TRUNCATED_SUFFIX))
        chain = F.when(cut, F.lit("truncated_max_tokens")).when(
            F.coalesce(text, F.lit("")) == "", F.lit("empty")
        )
    chain = chain.when(words < rules.min_words, F.format_string("too_short(%d)", words))
    chain = chain.when(words > rules.max_words, F.format_string("too_long(%d)", words))
    lowered = F.lower(text)
    for rule in rules.phrases:
        chain = chain.when(_has_phrases(lowered, rule), F.lit(rule.reason))
    return chain.otherwise(F.lit(OK))


def reason_kind(reason: Column) -> Column:
    """Reason without its measured value: too_short(17) -> too_short."""
    return F.regexp_extract(reason, r"^([^(]+)", 1)

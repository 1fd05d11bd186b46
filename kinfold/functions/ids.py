"""Message id scheme: building and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: <prefix>_<scenario>_<index>_<variant>; scenario may hold "_".
POSITIVE_ID = r"^phish_(.+)_(\d+)_([^_]+)$"


def padded(index: Column, width: int = 3) -> Column:
    """Zero padding to `width` that never cuts a longer number."""
    digits = index.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def phish_id(scenario: Column, index: Column, variant: Column) -> Column:
    return F.concat_ws("_", F.lit("phish"), scenario, padded(index), variant)


def legit_id(index: Column) -> Column:
    return F.concat_ws("_", F.lit("legit"), padded(index))


def id_scenario(msg_id: Column) -> Column:
    return F.regexp_extract(msg_id, POSITIVE_ID, 1)


def id_index(msg_id: Column) -> Column:
    """Numeric index of a positive id; null when the id has another shape."""
    return F.nullif(F.regexp_extract(msg_id, POSITIVE_ID, 2), F.lit("")).cast("bigint")


def id_variant(msg_id: Column) -> Column:
    return F.regexp_extract(msg_id, POSITIVE_ID, 3)


def base_id(msg_id: Column) -> Column:
    """Id of the original that a variant id belongs to."""
    return F.regexp_replace(msg_id, r"_[^_]+$", "_orig")

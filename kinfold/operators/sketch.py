"""A sketch of a set of keys, of a fixed size, that a scan can test before a join.

One bit per hash bucket, as an array of longs. A key of the set always passes; others
pass when they share a bucket, so an exact join has to follow. The sketch has the same
size for any number of keys: with far more keys than bits it lets everything pass and
costs a hash per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 18


@dataclass(frozen=True)
class Sketch:
    """The longs of the bits, and how many keys' buckets are set."""

    words: tuple[int, ...]

    @property
    def n_set(self) -> int:
        return sum((w & (2**64 - 1)).bit_count() for w in self.words)

    @property
    def passing(self) -> float:
        """Share of foreign keys that pass."""
        return self.n_set / (64 * len(self.words))

    def may_hold(self, *key: Column | str) -> Column:
        """False only where the key is not in the set; a null key is a key like others."""
        bucket = _bucket(64 * len(self.words), *key)
        # Split and cast of a literal: folded to an array once, when the query is planned.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        word = F.get(words, F.shiftright(bucket, 6).cast("int"))
        return F.getbit(word, (bucket % 64).cast("int")) == 1


def _bucket(bits: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def key_sketch(keys: DataFrame, *key: str, bits: int = BITS) -> Sketch:
    """The sketch of the keys in these columns. What comes to the driver are the longs
    that are not zero, `bits` / 64 at most. `bits` is a multiple of 64."""
    bucket = _bucket(bits, *key).alias("bucket")
    longs = keys.select(bucket).groupBy(F.shiftright("bucket", 6).cast("int").alias("at"))
    bit = F.expr("shiftleft(1L, cast(bucket % 64 AS int))")
    found = {r.at: r.word for r in longs.agg(F.bit_or(bit).alias("word")).collect()}
    return Sketch(tuple(found.get(k, 0) for k in range(bits // 64)))

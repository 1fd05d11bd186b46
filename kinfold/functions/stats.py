"""Student t tail probability: a closed form, and a series where that would cancel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
TERMS = 60  # each is less than half of the one before


def _steps(first: int, last: Column) -> Column:
    """first, first + 2, ... up to `last`, or nothing."""
    wanted = F.sequence(F.lit(first).cast("bigint"), last, F.lit(2).cast("bigint"))
    return F.when(last >= first, wanted).otherwise(F.array().cast("array<bigint>"))


def _closed(nu: Column, sine: Column, cosine: Column, theta: Column) -> Column:
    """1 - P(|T| < |t|) by the finite sums for even and odd degrees of freedom."""

    def summed(first: int, start: Column) -> Column:
        def add(acc: Column, power: Column) -> Column:
            term = acc["term"] * cosine * cosine * (power - 1) / power
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        begin = F.struct(start.alias("term"), start.alias("total"))
        return F.aggregate(_steps(first, nu - 2), begin, add, lambda acc: acc["total"])

    even = sine * summed(2, F.lit(1.0))
    odd = F.lit(2 / PI) * (theta + F.when(nu >= 3, sine * summed(3, cosine)).otherwise(0.0))
    return F.lit(1.0) - F.when(nu % 2 == 0, even).otherwise(odd)


def _tail(nu: Column, x: Column) -> Column:
    """The incomplete beta ratio I_x(nu/2, 1/2) by its power series, for x < 1/2."""
    a = nu / F.lit(2.0)
    # B(k + 1, 1/2) = B(k, 1/2) * k / (k + 1/2), from B(1/2, 1/2) = pi and B(1, 1/2) = 2.
    beta = F.aggregate(
        F.when(nu % 2 == 0, _steps(2, nu - 2)).otherwise(_steps(1, nu - 2)),
        F.when(nu % 2 == 0, F.lit(2.0)).otherwise(F.lit(PI)),
        lambda acc, n: acc * n / (n + 1),
    )

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * x * (a + 0.5 + n) / (a + 1 + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), one, add, lambda acc: acc["total"])
    return F.pow(x, a) * F.sqrt(F.lit(1.0) - x) / (a * beta) * series


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for `df` >= 1 degrees of freedom; null when t is null."""
    nu = df.cast("bigint")
    x = nu / (nu + t * t)  # squared cosine of the angle
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    p = F.when(x < 0.5, _tail(nu, x)).otherwise(_closed(nu, F.sin(theta), F.cos(theta), theta))
    return F.when(t.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))

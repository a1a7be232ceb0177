"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitsignal.functions.times import col


def power_of_ten(c: str | Column) -> Column:
    return F.pow(F.lit(10.0), col(c))


def power_of_two(c: str | Column) -> Column:
    return F.pow(F.lit(2.0), col(c))


def sin_degrees(c: str | Column) -> Column:
    return F.sin(F.radians(col(c)))


def cos_degrees(c: str | Column) -> Column:
    return F.cos(F.radians(col(c)))


def to_number(c: str | Column) -> Column:
    """Text to double; what is no number, and NaN, is null."""
    n = col(c).try_cast("double")
    return F.when(~F.isnan(n), n)


def linear_score(c: str | Column, intercept: float, slope: float) -> Column:
    return F.lit(float(intercept)) + F.lit(float(slope)) * col(c)


def ordered_bits(c: str | Column) -> Column:
    """The 64-bit form of a double as a whole number that is ordered as the doubles are.

    Positive numbers have their own bits, negative ones the bits of their amount below zero. Both zeros are 0; NaN is
    above infinity.
    """
    v = col(c)
    a = F.abs(v)

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e)

    guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))
    # The logarithm may be off by one next to a power of two.
    e = F.when(a < power(guess), guess - 1).when(a / power(guess) >= 2, guess + 1).otherwise(guess)
    normal = (e + 1023).cast("bigint") * F.lit(1 << 52) + ((a / power(e) - 1) * F.lit(2.0**52)).cast("bigint")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    amount = (
        F.when(F.isnan(v), F.lit((2047 << 52) + 1))
        .when(a == F.lit(float("inf")), F.lit(2047 << 52))
        .when(a < F.lit(2.0**-1022), small)
        .otherwise(normal)
    )
    return F.when(v < 0, -amount).otherwise(amount)


def from_ordered_bits(c: str | Column) -> Column:
    """The double of a number made by ``ordered_bits``."""
    bits = col(c)
    a = F.abs(bits)
    e, m = F.shiftright(a, 52), a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    amount = (
        F.when((e == 2047) & (m > 0), F.lit(float("nan")))
        .when(e == 2047, F.lit(float("inf")))
        .when(e == 0, m * F.lit(2.0**-537) * F.lit(2.0**-537))
        .otherwise((m / F.lit(2.0**52) + 1) * F.pow(F.lit(2.0), e - 1023))
    )
    return F.when(bits < 0, -amount).otherwise(amount)

"""Number helpers shared by every operator.

Rounding goes through a decimal, so a ratio rounds the same way whichever
engine or partition order produced it. Sums of money stay decimal until after
the sum, which makes them exact and independent of order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDING_TYPE = "decimal(28,8)"


def rounded(value: Column, digits: int = 2) -> Column:
    """Round a double half up at ``digits`` decimals; the result is a double."""
    return F.round(value.cast(ROUNDING_TYPE), digits).cast("double")


def money(total: Column) -> Column:
    """Round an exact decimal sum to cents; the result is a double."""
    return F.round(total, 2).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, 0 when the divisor is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return rounded(ratio(part, whole) * 100.0)


def mean_of(total: Column, count: Column) -> Column:
    return rounded(ratio(total, count))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def text1(value: Column) -> Column:
    """One decimal as text, for sentences."""
    return F.round(value.cast(ROUNDING_TYPE), 1).cast("decimal(28,1)").cast("string")


def signed_text1(value: Column) -> Column:
    return F.concat(F.when(value < 0, F.lit("")).otherwise(F.lit("+")), text1(value))


def sentence(template: str, *parts: Column) -> Column:
    """A template of the fixed values with its ``%s`` filled in; NULL if a part is."""
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, F.format_string(template, *(p.cast("string") for p in parts)))


def money_or_zero(total: Column) -> Column:
    """Like ``money``, with 0 where there was nothing to sum."""
    return money(F.coalesce(total, F.lit(0).cast("decimal(38,4)")))

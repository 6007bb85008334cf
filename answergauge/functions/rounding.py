"""Rounding and number texts that agree with IEEE semantics to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2 * 10^digits as descending powers of two.
_TERMS = {1: (16, 4), 2: (128, 64, 8)}


def round_exact(value: Column, digits: int) -> Column:
    """Round to 1 or 2 decimals, half to even on the exact binary value.

    Spark's own ``bround`` looks at the shortest decimal form, so it takes 0.35
    for a tie although the stored number is slightly below one. Here the value
    is scaled so that midpoints are odd whole numbers. The scaling adds exact
    power-of-two multiples and keeps the rounding error of their sum, which
    tells on which side of a midpoint the value really lies.
    """
    first, *rest = _TERMS[digits]
    total, error = value * first, F.lit(0.0)
    for power in rest:
        part = value * power
        grown = total + part
        error = error + (part - (grown - total))
        total = grown
    nearest = F.bround(total)
    side = F.signum((total - nearest) + error)
    midpoint = F.pmod(nearest, F.lit(2.0)) == 1
    return (
        F.when((F.abs(value) >= 1e13) | (midpoint & (side == 0)), F.bround(value, digits))
        .when(midpoint, (nearest + side) / (2 * 10**digits))
        .otherwise(nearest / (2 * 10**digits))
    )


def plain_number(value: Column) -> Column:
    """A double as text without an exponent from 0.0001 up to 10^16, ``70`` as ``70.0``."""
    text = value.cast("string")
    digits = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    full = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(value)
    wide = text.contains("E") & (size >= 1e-4) & (size < 1e16)
    return F.when(wide, full).otherwise(text)

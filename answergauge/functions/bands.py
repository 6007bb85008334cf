"""Thresholds: value bands, range status, and the pass/fail rule of a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge.functions.verdicts import ERROR, count_equal

# Band limits (inclusive upper bounds) and gate parameters.
LATENCY_LIMITS_MS = ((2500, "good"), (6000, "ok"))
SENTENCE_LIMITS = ((3, "good"), (5, "ok"))
STATUS_PASS, STATUS_OUT = "Pass", "OOS"
NO_RANGE = "no_range"  # of our own: the fact has no reference range
VETO, MIN_GOOD, MAX_BAD = "grounding", 4, 1


def band(value: Column, limits: Sequence[tuple[float, str]], otherwise: str = "bad") -> Column:
    """First label whose limit is not exceeded; NULL and NaN take ``otherwise``."""
    (limit, label), *rest = limits
    chain = F.when(value <= limit, label)
    for limit, label in rest:
        chain = chain.when(value <= limit, label)
    return chain.otherwise(otherwise)


def latency_band(latency_ms: Column) -> Column:
    return band(latency_ms, LATENCY_LIMITS_MS)


def length_band(sentences: Column) -> Column:
    return band(sentences, SENTENCE_LIMITS)


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Inclusive on both ends, compared as numbers."""
    return value.between(low, high)


def range_status(value: Column, low: Column, high: Column) -> Column:
    """``OOS`` strictly outside the range, else ``Pass`` (also where a number is NULL or NaN)."""
    value, low, high = (F.nanvl(x.cast("double"), F.lit(None).cast("double")) for x in (value, low, high))
    return F.when((value < low) | (value > high), STATUS_OUT).otherwise(STATUS_PASS)


def final_score(
    verdicts: Mapping[str, Column],
    veto: str = VETO,
    min_good: int = MIN_GOOD,
    max_bad: int = MAX_BAD,
) -> Column:
    """Pass/fail of one row.

    A row with a failed scoring cell stays ``ERROR``. Otherwise the veto
    criterion must be good, and then all criteria (the veto one included) are
    counted against ``min_good`` and ``max_bad``.
    """
    columns = list(verdicts.values())
    good, bad = count_equal(columns, "good"), count_equal(columns, "bad")
    return (
        F.when(count_equal(columns, ERROR) > 0, ERROR)
        .when(~verdicts[veto].eqNullSafe("good"), "fail")
        .when((good >= min_good) & (bad <= max_bad), "pass")
        .otherwise("fail")
    )

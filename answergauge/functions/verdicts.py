"""Verdict columns: domain, typo repair, ordinal scale, counting across columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verdict scale, its ordinals, the known typing slips of human
# raters, the marker of a row whose scoring failed, and the rated criteria.
VERDICTS = ("good", "ok", "bad")
ORDINAL = {"bad": 0, "ok": 1, "good": 2}
TYPOS = {"goood": "good", "bda": "bad"}
ERROR = "ERROR"
CRITERIA = ("fluency", "grammar", "tone", "length", "grounding")


def _lookup(key: Column, mapping: Mapping[str, object]) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(value: Column) -> Column:
    """Sheets write an empty cell as ``''``; treat it as not rated."""
    return F.nullif(value, F.lit(""))


def repair(verdict: Column, fixes: Mapping[str, str] = TYPOS) -> Column:
    """Replace known typing slips, pass every other value through."""
    return F.coalesce(_lookup(verdict, fixes), verdict)


def ordinal(verdict: Column, scale: Mapping[str, int] = ORDINAL) -> Column:
    """Position on the scale; NULL outside it (blank, ERROR, unknown words)."""
    return _lookup(verdict, scale)


def in_domain(verdict: Column, scale: Iterable[str] = VERDICTS) -> Column:
    """True or false, never NULL."""
    return F.coalesce(verdict.isin(*scale), F.lit(False))


def count_equal(columns: Iterable[Column], value: str) -> Column:
    """How many of the columns of one row hold ``value``."""
    total = F.lit(0)
    for column in columns:
        total = total + F.when(column == value, 1).otherwise(0)
    return total

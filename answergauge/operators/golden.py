"""Question sets with known answers, built from fact rows and checked against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.bands import STATUS_OUT
from answergauge.functions.text import NUMBER
from answergauge.operators.retrieve import mentioned_ids

# The question categories, in the order the type number picks them.
LOOKUP, STATUS, RANGE = "value_lookup", "status_reasoning", "range_reasoning"


def question_type(key: str, seed: str) -> Column:
    """A repeatable 0, 1 or 2 per row, from the leading hex digits of a hash."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(3))


def golden_set(
    facts: DataFrame, key: str, id_text: str, test: str, value: str, unit: str, seed: str,
    low: str = "reference_low", high: str = "reference_high",
) -> DataFrame:
    """Question, expected answer and category per fact row (with its range joined)."""
    v, lo, hi = (F.col(c).cast("string") for c in (value, low, high))
    place = F.when(F.col("in_range"), "inside").otherwise(f"outside ({STATUS_OUT})")
    kind = question_type(key, seed)
    question = (
        F.when(kind == 0, F.format_string(
            "What was the %s result of %s?", F.col(test), F.col(id_text)))
        .when(kind == 1, F.format_string(
            "Did %s pass or was it out of specification?", F.col(id_text)))
        .otherwise(F.format_string(
            "What is the valid range of %s, and is the result of %s inside it?",
            F.col(test), F.col(id_text)))
    )
    answer = (
        F.when(kind == 0, F.concat_ws(" ", v, F.col(unit)))
        .when(kind == 1, F.col("status"))
        .otherwise(F.concat(
            F.lit("Range "), lo, F.lit("-"), hi, F.lit(" "), F.col(unit),
            F.lit(". The result is "), place, F.lit(".")))
    )
    category = F.when(kind == 0, LOOKUP).when(kind == 1, STATUS).otherwise(RANGE)
    return facts.select(
        "*", question.alias("question"), answer.alias("expected_answer"), category.alias("category"))


def self_check(
    questions: DataFrame, facts: DataFrame, pattern: str, id_text: str, value: str,
    low: str = "reference_low", high: str = "reference_high",
) -> DataFrame:
    """Does every expected answer follow from the fact row its question names?

    The fact is found by the id inside the question, not by the row the
    question was built from.
    """
    ids = mentioned_ids(F.col("question"), pattern)
    asked = questions.select(
        "question", "expected_answer", "category", F.col(id_text).alias("expected_id"),
        ids.alias("ids"), F.get(ids, F.lit(0)).alias("_id"))
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    joined = asked.join(facts.withColumnRenamed(id_text, "_id"), "_id", "left")
    outside = (v < lo) | (v > hi)
    bounds = F.regexp_extract_all("expected_answer", F.lit(NUMBER), F.lit(0))
    agrees = (
        F.when(F.col("category") == LOOKUP, F.get(bounds, F.lit(0)).cast("double") == v)
        .when(F.col("category") == STATUS, (F.col("expected_answer") == STATUS_OUT) == outside)
        .otherwise(
            (F.get(bounds, F.lit(0)).cast("double") == lo)
            & (F.get(bounds, F.lit(1)).cast("double") == hi)
            & (F.contains("expected_answer", F.lit(STATUS_OUT)) == outside))
    )
    return joined.select(
        "question", "category",
        ((F.size("ids") == 1) & (F.col("_id") == F.col("expected_id"))).alias("id_ok"),
        F.coalesce(agrees, F.lit(False)).alias("answer_ok"))

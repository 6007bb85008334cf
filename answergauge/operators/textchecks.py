"""Countable checks of answer texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.bands import length_band
from answergauge.functions.text import (
    drop_off_script_words,
    first_sentences,
    mentions_number,
    numbers,
    off_script_chars,
    off_script_share,
    sentence_count,
)
from answergauge.operators.quotes import find_quotes

# Words that state a status.
STATUS_WORDS = r"\b(Pass|OOS)\b"


def value_in_answer(df: DataFrame, text: str, expected: str) -> DataFrame:
    return df.withColumn("value_present", mentions_number(F.col(text), F.col(expected)))


def status_instead_of_range(
    df: DataFrame, text: str, category: str, range_category: str, bounds: list[str],
    status_words: str = STATUS_WORDS,
) -> DataFrame:
    """Range questions answered with a status although the range bounds are absent."""
    stated = F.lit(True)
    for bound in bounds:
        stated = stated & mentions_number(F.col(text), F.col(bound))
    return df.where(
        (F.col(category) == range_category) & F.col(text).rlike(status_words) & ~stated)


def language_leakage(df: DataFrame, text: str) -> DataFrame:
    """Characters outside the expected script per row, as count and share."""
    return df.withColumns({
        "off_script_chars": off_script_chars(F.col(text)),
        "off_script_share": off_script_share(F.col(text)),
    })


def leakage_by(df: DataFrame, by: list[str], limit: Column) -> DataFrame:
    """Mean share per group and rows above the (possibly per-row) limit."""
    share = F.col("off_script_share")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(share).alias("mean_share"),
        F.max(share).alias("max_share"),
        F.count_if(share > limit).alias("n_over_limit"),
    )


def length_bands(df: DataFrame, text: str) -> DataFrame:
    counted = df.withColumn("sentences", sentence_count(F.col(text)))
    return counted.withColumn("length_verdict", length_band(F.col("sentences")))


def single_sentence_share(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of one-sentence answers per group, from ``length_bands`` output."""
    one = F.col("sentences") == 1
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(one).alias("n_single"),
        F.avg(one.cast("double")).alias("single_share"),
    )


def example_echo(df: DataFrame, text: str, literals: list[float]) -> DataFrame:
    """Answers that repeat a number of the examples given in the prompt.

    ``literals`` is the example list itself, a handful of constants.
    """
    listed = F.array(*[F.lit(float(x)) for x in literals])
    echoed = F.array_intersect(numbers(F.col(text)), listed)
    return df.withColumn("echoed", F.size(echoed)).where(F.col("echoed") > 0)


def phrase_echo(
    df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, store: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Answers that repeat a phrase of the examples given in the prompt: (key, phrases repeated, the first of them).

    ``phrases`` is a table of any length. Each answer is searched once, through
    the index of ``find_quotes``, whatever the number of phrases.
    """
    found = find_quotes(phrases, phrase, df, key, text, store)
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("echoed"), F.min(phrase).alias("first_echo"))


def unrequested_facts(
    df: DataFrame, text: str, category: str, allowed: dict[str, list[str]],
    status_words: str = STATUS_WORDS, status_categories: tuple[str, ...] = (),
) -> DataFrame:
    """Numbers and status words an answer states although its question did not ask.

    ``allowed`` maps a category to the columns whose numbers it may state;
    ``status_categories`` may also state a status. A category that is not listed
    may state no number at all.
    """
    extra = numbers(F.col(text))
    for name, columns in allowed.items():
        known = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
        extra = F.when(
            F.col(category) == name, F.array_except(numbers(F.col(text)), known)).otherwise(extra)
    states = F.col(text).rlike(status_words) & ~F.col(category).isin(*status_categories)
    return df.withColumns({
        "extra_numbers": F.coalesce(F.size(extra), F.lit(0)),
        "extra_status": F.coalesce(states, F.lit(False)),
    }).withColumn("padded", (F.col("extra_numbers") > 0) | F.col("extra_status"))


def padding_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("padded").alias("n_padded"),
        F.avg(F.col("padded").cast("double")).alias("padded_rate"),
    )


def clean_answers(df: DataFrame, text: str, max_sentences: int | None = None) -> DataFrame:
    """Drop off-script words; with ``max_sentences`` also apply the length rule."""
    cleaned = drop_off_script_words(F.col(text))
    if max_sentences is not None:
        cleaned = first_sentences(cleaned, max_sentences)
    return df.withColumn("cleaned", cleaned)


def sections(
    df: DataFrame, keep: list[str], text: str, section_break: str, clause_break: str
) -> DataFrame:
    """Corpus texts as rows (section number, clause number, text).

    Both splits are inside one row, so a text never leaves its task.
    """
    by_section = df.select(
        *keep, F.posexplode(F.split(F.col(text), section_break)).alias("section_no", "_section"))
    return by_section.select(
        *keep, "section_no",
        F.posexplode(F.split("_section", clause_break)).alias("clause_no", "clause"))

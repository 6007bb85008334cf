"""Measures and clean-up of answer text, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.rounding import plain_number, round_exact

# Patterns shared by the text checks.
NUMBER = r"[0-9]+(\.[0-9]+)?"
SIGNED_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
HYPHEN = r"([0-9A-Za-z])-"  # joins words or ends of a range, no sign
SENTENCE_END = r"[.!?]+"
SENTENCE = r"[^.!?]+[.!?]*"
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_RUN = r"[\x00-\x7F]+"
# A word with an off-script character, entered at its start only and without
# backtracking, so that the scan is linear in the text.
OFF_SCRIPT_WORD = r"(?<!\S)[\x00-\x7F&&\S]*+[^\x00-\x7F]\S*"
FENCE = "```"
FENCED = r"(?s)^```(?:json)?(.*?)(?:```|\z)"


def strip(text: Column) -> Column:
    """Trim white space of every kind (newlines, no-break spaces) at both ends."""
    return F.trim(text, F.lit(SPACES))


def is_ascii(text: Column) -> Column:
    """One byte per character; lets clean texts skip the regular expressions."""
    return F.octet_length(text) == F.length(text)


def preview(text: Column, n: int = 200) -> Column:
    """Leading characters, for a report column only."""
    return F.left(text, F.lit(n))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sentence_count(text: Column) -> Column:
    """Runs of end marks."""
    return F.regexp_count(text, F.lit(SENTENCE_END))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]"))


def occurrences(text: Column, literal: str) -> Column:
    """Count of a literal substring without building an array of matches."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / len(literal)).cast("int")


def off_script_chars(text: Column, expected: str = ASCII_RUN) -> Column:
    """Characters left once runs of the expected script are removed."""
    left = F.length(F.regexp_replace(text, expected, ""))
    return F.when(is_ascii(text), 0).otherwise(left) if expected == ASCII_RUN else left


def off_script_share(text: Column, expected: str = ASCII_RUN) -> Column:
    """Share of characters outside the expected script; NULL for an empty text."""
    return F.try_divide(off_script_chars(text, expected), F.length(text))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as doubles. A minus counts, the hyphen of ``70-100`` or ``P-12`` does not."""
    found = F.regexp_extract_all(F.regexp_replace(text, HYPHEN, "$1 "), F.lit(SIGNED_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: x.cast("double")))


def mentions_number(text: Column, expected: Column) -> Column:
    """The expected value occurs in the text, compared as a number (70 equals 70.0)."""
    return F.coalesce(F.array_contains(numbers(text), expected.cast("double")), F.lit(False))


def strip_fence(raw: Column) -> Column:
    """Body of a code-fenced reply, without the ``json`` tag; other text as it is."""
    body = F.regexp_extract(raw, FENCED, 1)
    return strip(F.when(F.startswith(raw, F.lit(FENCE)), body).otherwise(raw))


def drop_off_script_words(text: Column) -> Column:
    """Remove every blank-delimited word that holds a non-ASCII character."""
    kept = F.when(is_ascii(text), text).otherwise(F.regexp_replace(text, OFF_SCRIPT_WORD, ""))
    return strip(F.regexp_replace(kept, "  +", " "))


def first_sentences(text: Column, n: int) -> Column:
    """The first ``n`` sentences, the length rule of an answer."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return strip(F.array_join(F.slice(found, 1, n), ""))


def csv_cell(value: Column) -> Column:
    """One CSV cell: empty for NULL, quoted only when needed, quotes doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\r\n]'), quoted).otherwise(text)


def csv_line(df: DataFrame, columns: list[str]) -> Column:
    """The named columns of a row as one CSV line."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    cells = [plain_number(F.col(c)) if c in doubles else F.col(c) for c in columns]
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def percent(share: Column) -> Column:
    """``0.577`` as ``57.7%``."""
    return F.format_string("%.1f%%", round_exact(share * 100, 1))


def signed(value: Column) -> Column:
    """``0.6`` as ``+0.60``."""
    return F.format_string("%+.2f", round_exact(value, 2))

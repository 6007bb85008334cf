"""Questions to facts, and the request text sent to the answering service.

A question without any id falls back to the whole fact table. Copying the table
into each such request would multiply facts by questions, so those requests
carry the reference ``ALL`` and the table is rendered once, in bounded blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.text import csv_line

# Where the facts of a request come from.
BY_ID, ALL_FACTS = "IDS", "ALL"


def mentioned_ids(text: Column, pattern: str, expected: Column | None = None) -> Column:
    """Distinct ids in a text; a non-blank expected id is added when not mentioned."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    if expected is None:
        return found
    extra = F.when(F.coalesce(expected, F.lit("")) == "", F.array().cast("array<string>"))
    return F.array_union(found, extra.otherwise(F.array(expected)))


def with_ids(
    questions: DataFrame, text: str, pattern: str, expected: str | None = None
) -> DataFrame:
    """Add ``ids`` and ``context_ref`` (``IDS``, or ``ALL`` when there is no id)."""
    ids = mentioned_ids(F.col(text), pattern, F.col(expected) if expected else None)
    return questions.withColumn("ids", ids).withColumn(
        "context_ref", F.when(F.size("ids") > 0, BY_ID).otherwise(ALL_FACTS))


def matching_facts(questions: DataFrame, key: str, facts: DataFrame, fact_id: str) -> DataFrame:
    """One row per (question, mentioned fact).

    The id is a plain equi-join key. When one id is named by a large part of all
    questions, adaptive execution splits its partition.
    """
    wanted = questions.select(key, F.explode("ids").alias("_id"))
    # cast on the question side, so the fact table joins on its own column
    typed = wanted.withColumn("_id", F.col("_id").try_cast(facts.schema[fact_id].dataType))
    return typed.join(facts, F.col("_id") == F.col(fact_id)).drop("_id")


def retrieve(questions: DataFrame, key: str, facts: DataFrame, fact_id: str) -> DataFrame:
    """Matching facts, plus one ``ALL`` marker row per question without ids."""
    matched = matching_facts(questions, key, facts, fact_id).withColumn("context_ref", F.lit(BY_ID))
    rest = questions.where(F.col("context_ref") == ALL_FACTS).select(key, "context_ref")
    return matched.unionByName(rest, allowMissingColumns=True)


def fact_blocks(
    facts: DataFrame, columns: list[str], position: Column, span: int = 1000
) -> DataFrame:
    """The fact table as CSV text in blocks of at most ``span`` consecutive positions.

    ``position`` is an integer that differs from row to row (a numeric id, or the
    number inside a text id), so no group is unbounded.
    """
    lines = facts.select(
        F.floor(position / span).alias("block_no"), position.alias("_at"),
        csv_line(facts, columns).alias("_line"))
    return lines.groupBy("block_no").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(r"listagg(_line, '\n') WITHIN GROUP (ORDER BY _at)").alias("block"),
    )


def text_blocks(corpus: DataFrame, keys: list[str], text: str, span: int = 100_000) -> DataFrame:
    """(keys, block_no, block): corpus texts in blocks of at most ``span`` characters, none left out.

    Requests refer to a corpus by name, so it may be of any size and number of files.
    """
    size = F.greatest(F.length(text), F.lit(1))
    numbered = corpus.where(F.col(text).isNotNull()).select(
        *keys, text, F.explode(F.sequence(F.lit(0), F.floor((size - 1) / span).cast("int"))).alias("block_no"))
    return numbered.select(
        *keys, "block_no", F.substring(F.col(text), F.col("block_no") * span + 1, F.lit(span)).alias("block"))


def fact_context(
    questions: DataFrame, key: str, facts: DataFrame, fact_id: str, columns: list[str]
) -> DataFrame:
    """(key, facts_csv): the matched facts of each question that names ids.

    Grouping is by question and bounded by the ids in its own text.
    """
    rendered = facts.select(fact_id, csv_line(facts, columns).alias("_line"))
    lines = matching_facts(questions, key, rendered, fact_id)
    return lines.groupBy(key).agg(
        F.expr(rf"listagg(_line, '\n') WITHIN GROUP (ORDER BY {fact_id})").alias("facts_csv"))


def build_requests(
    questions: DataFrame,
    key: str,
    text: str,
    facts: DataFrame,
    fact_id: str,
    fact_columns: list[str],
    reference: str,
    corpus: str | None = None,
    extra: list[tuple[str, str]] = (),
) -> DataFrame:
    """Request text per question: facts, reference table, corpus, labelled lines.

    ``reference`` and ``corpus`` name what all requests share; it is rendered once
    (``fact_blocks``, ``text_blocks``) and never copied into a request. Questions
    keep their row even when no id matches a fact. ``extra`` lists (label, column).
    """
    context = fact_context(questions, key, facts, fact_id, fact_columns)
    header = F.lit(",".join(fact_columns))
    facts_text = F.when(F.col("context_ref") == ALL_FACTS, F.lit("see blocks: " + ALL_FACTS)).otherwise(
        F.concat_ws("\n", header, F.col("facts_csv")))
    parts = [
        F.lit("## Facts"), facts_text,
        F.lit("## Reference ranges"), F.lit(f"see blocks: {reference}"),
    ]
    if corpus is not None:
        parts += [F.lit("## Procedures"), F.lit(f"see blocks: {corpus}")]
    parts += [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for label, c in extra]
    parts.append(F.concat(F.lit("Question: "), F.col(text)))
    return questions.join(context, key, "left").select(
        key, "context_ref", F.concat_ws("\n", *parts).alias("request"))

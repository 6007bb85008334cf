"""Replies of the answering and the judging service, read as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.rounding import round_exact
from answergauge.functions.text import strip, strip_fence
from answergauge.functions.verdicts import CRITERIA, ERROR, in_domain
from answergauge.operators.gate import gate
from answergauge.operators.quotes import find_quotes

# The citation marker and the refusal sentence of the answer
# contract, and the types a JSON number field accepts when read leniently.
CITATION = "Reference: "
REFUSAL = "I can't find that in the document."
NUMBER_TYPES = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|STRING|BOOLEAN)$"


def reply_text(blocks: Column) -> Column:
    """Join the text blocks of a reply in order, drop the others, trim."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return strip(F.array_join(texts, ""))


def run_records(
    df: DataFrame, keep: list[str], blocks: str, latency_ms: str, usage: str, ratings: list[str]
) -> DataFrame:
    """The sheet row of a reply: its question fields, text, latency, tokens, empty ratings."""
    return df.select(
        *keep,
        reply_text(F.col(blocks)).alias("generated_description"),
        round_exact(F.col(latency_ms), 1).alias("latency_ms"),
        F.col(f"{usage}.input_tokens").cast("bigint").alias("input_tokens"),
        F.col(f"{usage}.output_tokens").cast("bigint").alias("output_tokens"),
        *[F.lit(None).cast("string").alias(r) for r in ratings],
    )


def _single(raw: Column) -> Column:
    """The one JSON value of a reply; NULL where there is none, or anything after it."""
    whole = F.try_parse_json(F.concat(F.lit("["), strip_fence(raw), F.lit("]")))
    second = F.try_variant_get(whole, "$[1]", "variant")
    return F.when(second.isNull(), F.try_variant_get(whole, "$[0]", "variant"))


def _kind(value: str, path: str) -> Column:
    """Type of a field: NULL where it is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def validate_answers(
    df: DataFrame, raw: str, require_unit_range: bool = False
) -> DataFrame:
    """Parse ``{"answer": text, "confidence": number}`` replies, fenced or not.

    Adds ``answer``, ``confidence`` and ``reason`` (NULL for a valid reply).
    Extra fields are ignored and a numeric string counts as a number. The 0-to-1
    rule for the confidence is a separate choice.
    """
    parsed = df.withColumn("_v", _single(F.col(raw)))

    typed = parsed.withColumns({
        "_root": F.schema_of_variant("_v"),
        "_answer": _kind("_v", "$.answer"),
        "_confidence": _kind("_v", "$.confidence"),
    })
    text = F.when(F.col("_answer") == "STRING", F.try_variant_get("_v", "$.answer", "string"))
    number = F.when(
        F.col("_confidence").rlike(NUMBER_TYPES), F.try_variant_get("_v", "$.confidence", "double"))
    valued = typed.withColumns({"answer": text, "confidence": number})
    reason = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~F.startswith("_root", F.lit("OBJECT")), "not_an_object")
        .when(F.col("_answer").isNull(), "missing_answer")
        .when(F.col("_confidence").isNull(), "missing_confidence")
        .when(F.col("answer").isNull(), "answer_not_text")
        .when(F.col("confidence").isNull(), "confidence_not_number")
    )
    if require_unit_range:
        reason = reason.when(~F.col("confidence").between(0, 1), "confidence_out_of_range")
    ok = F.col("reason").isNull()
    checked = valued.withColumn("reason", reason)
    return checked.withColumns({
        "answer": F.when(ok, F.col("answer")),
        "confidence": F.when(ok, F.col("confidence")),
    }).drop("_v", "_root", "_answer", "_confidence")


def reason_counts(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    return (
        validated.groupBy(*(by or []), F.coalesce("reason", F.lit("valid")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def verdict_schema(criteria: tuple[str, ...] = CRITERIA) -> str:
    """Explanation before verdict, the order the judging service is asked for."""
    cell = "STRUCT<explanation: STRING, verdict: STRING>"
    return ", ".join(f"{c} {cell}" for c in criteria)


def validate_verdicts(
    df: DataFrame, raw: str, criteria: tuple[str, ...] = CRITERIA
) -> DataFrame:
    """Parse nested verdict replies.

    A reply is usable only when it is one JSON object and every criterion has an
    explanation that is a text and a verdict on the scale; otherwise ``reason`` says why and each ``{criterion}_verdict`` is ERROR.
    """
    parsed = df.withColumn("_v", _single(F.col(raw)))
    fields = [f"{c}.{x}" for c in criteria for x in ("verdict", "explanation")]
    texts = {f"_{x.replace('.', '_')}": F.when(
        _kind("_v", f"$.{x}") == "STRING", F.try_variant_get("_v", f"$.{x}", "string")) for x in fields}
    parsed = parsed.withColumns(texts)
    missing, off_scale = F.lit(0), F.lit(0)
    for c in criteria:
        verdict = F.col(f"_{c}_verdict")
        absent = verdict.isNull() | F.col(f"_{c}_explanation").isNull()
        missing = missing + F.when(absent, 1).otherwise(0)
        off_scale = off_scale + F.when(~absent & ~in_domain(verdict), 1).otherwise(0)
    counted = parsed.withColumns({"n_missing": missing, "n_off_scale": off_scale})
    reason = (
        F.when(F.col("n_missing") == len(criteria), "unreadable")
        .when(F.col("n_missing") > 0, "missing_criterion")
        .when(F.col("n_off_scale") > 0, "verdict_off_scale")
    )
    judged = counted.withColumn("reason", reason)
    failed = F.col("reason").isNotNull()
    return judged.withColumns({
        name: value
        for c in criteria
        for name, value in (
            (f"{c}_verdict", F.when(failed, ERROR).otherwise(F.col(f"_{c}_verdict"))),
            (f"{c}_explanation",
             F.when(failed, F.col("reason")).otherwise(F.col(f"_{c}_explanation"))),
        )
    }).drop("_v", *texts)


def gate_replies(
    df: DataFrame, raw: str, latency_ms: str, criteria: tuple[str, ...] = CRITERIA
) -> DataFrame:
    """Judge replies to pass/fail in one projection: parse, band the latency, gate.

    A reply that cannot be used turns its own row into ERROR.
    """
    judged = validate_verdicts(df, raw, criteria)
    return gate(
        judged, {c: f"{c}_verdict" for c in criteria}, latency_ms,
        failed=F.col("reason").isNotNull())


def melt_verdicts(
    df: DataFrame, keys: list[str], rater: str, criteria: tuple[str, ...] = CRITERIA
) -> DataFrame:
    """Wide judged rows to the long table (keys, rater, criterion, verdict, explanation)."""
    cells = [
        F.struct(
            F.lit(rater).alias("rater"), F.lit(c).alias("criterion"),
            F.col(f"{c}_verdict").alias("verdict"), F.col(f"{c}_explanation").alias("explanation"))
        for c in criteria
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def with_quote(replies: DataFrame, reply: str, out: str = "quote") -> DataFrame:
    """Adds the trimmed text after the citation marker; NULL for a refusal, or where there is none."""
    marker = F.instr(F.col(reply), CITATION)
    quote = F.when(
        marker > 0, F.substring(F.col(reply), marker + len(CITATION), F.length(F.col(reply))))
    return replies.withColumn(out, F.when(~_refused(reply), F.nullif(strip(quote), F.lit(""))))


def _refused(reply: str) -> Column:
    return F.coalesce(strip(F.col(reply)) == REFUSAL, F.lit(False))


def check_citations(
    replies: DataFrame, documents: DataFrame, doc_id: str, reply: str, text: str
) -> DataFrame:
    """Outcome per reply: supported, unsupported, refused or no_citation.

    The quote after the marker has to occur verbatim in the reply's document.
    One left join, on a document id that only replies with a quote have, so the
    others meet no text; they are spread by their own hash. A document cited by
    very many replies is split by adaptive execution.
    """
    read = with_quote(replies, reply, "_quote").withColumns({
        "_id": F.when(F.col("_quote").isNotNull(), F.col(doc_id)),
        "_spread": F.when(F.col("_quote").isNull(), F.xxhash64(doc_id, reply)).otherwise(F.lit(0))})
    keyed = documents.select(F.col(doc_id).alias("_id"), F.lit(0).cast("bigint").alias("_spread"), F.col(text).alias("_text"))
    met = read.join(keyed, ["_id", "_spread"], "left")
    outcome = (
        F.when(_refused(reply), "refused")
        .when(F.col("_quote").isNull(), "no_citation")
        .when(F.contains("_text", F.col("_quote")), "supported")
        .otherwise("unsupported")
    )
    return met.withColumn("outcome", outcome).select(*replies.columns, "outcome")


def search_citations(
    replies: DataFrame, documents: DataFrame, doc_id: str, reply: str, text: str,
    store: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Replies with a quote, and where it stands: ``found_in`` documents, the least of their ids ``first_doc``.

    For replies that name no document, or a wrong one: all documents are
    searched, through the index of ``find_quotes``. A quote that stands nowhere has 0 and NULL.
    """
    quoted = with_quote(replies, reply, "_quote").where(F.col("_quote").isNotNull())
    found = find_quotes(quoted, "_quote", documents, doc_id, text, store)
    places = found.groupBy("_quote").agg(
        F.count(F.lit(1)).alias("found_in"), F.min(doc_id).alias("first_doc"))
    return quoted.join(places, "_quote", "left").drop("_quote").withColumn(
        "found_in", F.coalesce("found_in", F.lit(0).cast("bigint")))

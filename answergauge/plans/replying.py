"""Replies as data: texts, records, validation, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.functions.verdicts import CRITERIA
from answergauge.operators import replies as rp
from answergauge.operators.gate import upsert
from answergauge.plans import inputs as src
from answergauge.plans.registry import collector
from answergauge.session import stored
from answergauge.sources.readers import read_table

QUERIES, query = collector()


@query(f"""SELECT doc_id, md5(reply) AS reply_md5, length(reply) AS reply_chars FROM (
  SELECT doc_id, {src.sql_strip('''array_to_string(list_filter(string_split(text, chr(10)),
    lambda x: NOT regexp_matches(x, '[0-9]')), '')''')} AS reply FROM documents)""")
def reply_text(spark, sf):
    """Each line of a document is a block; a line with digits stands for a tool call."""
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.when(line.rlike("[0-9]"), "tool_use").otherwise("text").alias("type"),
            line.alias("text")))
    reply = src.documents(spark, sf).select("doc_id", rp.reply_text(blocks).alias("reply"))
    return reply.select(
        "doc_id", F.md5("reply").alias("reply_md5"), F.length("reply").alias("reply_chars"))


@query(f"""SELECT u.conv_id, u.turn, u.text AS question, {src.sql_strip('a.text')} AS generated_description,
  round_even(e.value * 50, 1) AS latency_ms, ceil(length(u.text) / 4.0)::BIGINT AS input_tokens,
  ceil(length(a.text) / 4.0)::BIGINT AS output_tokens, NULL::VARCHAR AS fluency, NULL::VARCHAR AS final_score
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
LEFT JOIN events e ON e.event_id = u.conv_id
WHERE u.role = 'user' AND a.role = 'assistant'""")
def run_records(spark, sf):
    """A user turn with the assistant turn right after it.

    Joined on (conversation, turn), which is unique: one endless conversation
    spreads over all tasks, where a window over it would not.
    """
    turns = read_table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = asked.join(replied, ["conv_id", "turn"]).select(
        "conv_id", "turn", "question",
        F.array(F.struct(F.lit("text").alias("type"), F.col("reply").alias("text"))).alias("content"),
        F.struct(
            F.ceil(F.length("question") / 4).alias("input_tokens"),
            F.ceil(F.length("reply") / 4).alias("output_tokens")).alias("usage"))
    timed = pairs.join(
        src.latencies(spark, sf).select(F.col("doc_id").alias("conv_id"), "latency_ms"), "conv_id", "left")
    return rp.run_records(
        timed, ["conv_id", "turn", "question"], "content", "latency_ms", "usage",
        ["fluency", "final_score"])


def _answers(spark, sf):
    """Replies wrapped from event properties, some of them malformed per event type."""
    k, kind = F.col("k"), F.col("event_type")
    head = F.concat(F.lit('{"answer": "'), kind, F.lit('"'))
    percent = F.concat(k.cast("string"), F.lit("e-2"))
    raw = (
        F.when(kind == "purchase", F.concat(
            F.lit("```json\n"), head, F.lit(', "confidence": '), percent, F.lit("}\n```")))
        .when(kind == "signup", F.concat(
            head, F.lit(', "extra": null, "confidence": "'), percent, F.lit('"}')))
        .when(kind == "view", F.concat(
            F.lit("```\n"), head, F.lit(', "confidence": '),
            (k * 2).cast("string"), F.lit("e-2}\n```\nDone.")))
        .when((kind == "click") & (k < 20), F.concat(
            head, F.lit(', "confidence": '), percent, F.lit("} as asked")))
        .when((kind == "click") & (k < 35), F.concat(
            head, F.lit(', "confidence": '), percent, F.lit('}, {"answer": "again"}')))
        .when((kind == "click") & (k < 50), F.concat(head, F.lit(', "confidence": '), percent))
        .when(kind == "click", F.concat(
            F.lit('{"answer": '), k.cast("string"), F.lit(', "confidence": 0.5}')))
        .when(k < 10, "null")
        .when(k < 50, F.concat(head, F.lit("}")))
        .otherwise(F.concat(head, F.lit(', "confidence": "high"}')))
    )
    events = read_table(spark, sf, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    replies = events.select("event_id", "event_type", raw.alias("raw"))
    return rp.validate_answers(replies, "raw", require_unit_range=True)


_ANSWERS_SQL = """k AS (SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
checked AS (SELECT *, CASE
    WHEN event_type = 'view' AND k > 50 THEN 'confidence_out_of_range'
    WHEN event_type = 'click' AND k < 50 THEN 'invalid_json'
    WHEN event_type = 'click' THEN 'answer_not_text'
    WHEN event_type = 'error' AND k < 10 THEN 'not_an_object'
    WHEN event_type = 'error' AND k < 50 THEN 'missing_confidence'
    WHEN event_type = 'error' THEN 'confidence_not_number' END AS reason FROM k)"""


@query(f"""WITH {_ANSWERS_SQL}
SELECT event_id, reason, CASE WHEN reason IS NULL THEN event_type END AS answer,
  CASE WHEN reason IS NULL THEN round(k * CASE event_type WHEN 'view' THEN 2 ELSE 1 END / 100, 6) END
    AS confidence
FROM checked""")
def reply_validation(spark, sf):
    return _answers(spark, sf).select(
        "event_id", "reason", "answer", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_ANSWERS_SQL}
SELECT event_type, coalesce(reason, 'valid') AS outcome, count(*) AS n FROM checked GROUP BY ALL""")
def reply_reasons(spark, sf):
    return rp.reason_counts(_answers(spark, sf), ["event_type"])


def _raw_verdicts(spark, sf):
    """Judge replies as fenced JSON; Spanish rows lack the tone, short French rows are prose,
    short German ones explain with numbers, and short English ones go on after the object."""
    cells = [
        F.when(
            F.lit(c != "tone") | (F.col("category") != "es"),
            F.struct(
                F.concat(F.lit("because "), F.col("category")).alias("explanation"),
                F.col(f"human_{c}").alias("verdict"))).alias(c)
        for c in CRITERIA
    ]
    prose = (F.col("category") == "fr") & (F.col("n_chars") < 2000)
    numbers = (F.col("category") == "de") & (F.col("n_chars") < 1000)
    more = (F.col("category") == "en") & (F.col("n_chars") < 500)
    json = F.to_json(F.struct(*cells))
    body = F.when(numbers, F.replace(json, F.lit('"because de"'), F.lit("5"))).when(
        more, F.concat(json, F.lit("\nThat is all."))).otherwise(json)
    reply = F.when(prose, "I cannot judge this.").otherwise(
        F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return src.rated_sheet(spark, sf).select("run_id", "doc_id", reply.alias("reply"))


def _verdict_replies(spark, sf):
    return rp.validate_verdicts(_raw_verdicts(spark, sf), "reply")


_OFF = " + ".join(
    f"(human_{c} NOT IN ('good', 'ok', 'bad'))::INT" for c in CRITERIA)
_OFF_NO_TONE = " + ".join(
    f"(human_{c} NOT IN ('good', 'ok', 'bad'))::INT" for c in CRITERIA if c != "tone")
_UNREADABLE = ("(category = 'fr' AND n_chars < 2000 OR category = 'de' AND n_chars < 1000"
               " OR category = 'en' AND n_chars < 500)")
_VERDICTS_SQL = f"""{src.RATED_SQL}, counted AS (
  SELECT *, CASE WHEN {_UNREADABLE} THEN 5 WHEN category = 'es' THEN 1 ELSE 0 END
      AS n_missing,
    CASE WHEN {_UNREADABLE} THEN 0
         WHEN category = 'es' THEN {_OFF_NO_TONE} ELSE {_OFF} END AS n_off_scale
  FROM rated),
parsed AS (SELECT *, CASE WHEN n_missing = 5 THEN 'unreadable' WHEN n_missing > 0 THEN 'missing_criterion'
    WHEN n_off_scale > 0 THEN 'verdict_off_scale' END AS reason FROM counted)"""


@query(f"""WITH {_VERDICTS_SQL}
SELECT run_id, doc_id, n_missing, n_off_scale, reason, {', '.join(
  f"CASE WHEN reason IS NULL THEN human_{c} ELSE 'ERROR' END AS {c}_verdict" for c in CRITERIA)}
FROM parsed""")
def verdict_json_validation(spark, sf):
    return _verdict_replies(spark, sf).select(
        "run_id", "doc_id", "n_missing", "n_off_scale", "reason", *[f"{c}_verdict" for c in CRITERIA])


@query(f"""WITH {_VERDICTS_SQL} """ + " UNION ALL ".join(
    f"""SELECT run_id, doc_id, 'judge' AS rater, '{c}' AS criterion,
  CASE WHEN reason IS NULL THEN human_{c} ELSE 'ERROR' END AS verdict,
  coalesce(reason, 'because ' || category) AS explanation FROM parsed""" for c in CRITERIA))
def judged_verdicts(spark, sf):
    """The long verdict table read from judge replies."""
    return rp.melt_verdicts(_verdict_replies(spark, sf), ["run_id", "doc_id"], "judge")


_GOOD, _BAD = (" + ".join(f"(human_{c} = '{v}')::INT" for c in CRITERIA) for v in ("good", "bad"))


@query(f"""WITH {_VERDICTS_SQL}, timed AS (
  SELECT p.*, CASE WHEN value * 50 <= 2500 THEN 'good' WHEN value * 50 <= 6000 THEN 'ok' ELSE 'bad' END
    AS latency FROM parsed p LEFT JOIN events e ON e.event_id = p.doc_id)
SELECT run_id, doc_id, CASE WHEN reason IS NOT NULL THEN 'ERROR' ELSE latency END AS judge_latency_verdict,
  CASE WHEN reason IS NOT NULL THEN 'ERROR' WHEN human_grounding <> 'good' THEN 'fail'
    WHEN {_GOOD} + (latency = 'good')::INT >= 4 AND {_BAD} + (latency = 'bad')::INT <= 1 THEN 'pass'
    ELSE 'fail' END AS judge_final_score FROM timed""")
def gate_from_replies(spark, sf):
    """The whole judging step: reply, verdicts, latency band, pass or fail."""
    replies = _raw_verdicts(spark, sf).join(
        src.latencies(spark, sf).select("doc_id", "latency_ms"), "doc_id", "left")
    return rp.gate_replies(replies, "reply", "latency_ms").select(
        "run_id", "doc_id", "judge_latency_verdict", "judge_final_score")


_EXPLAINED = [x for c in CRITERIA for x in (f"judge_{c}_verdict", f"judge_{c}_explanation")]


@query(f"""WITH {_VERDICTS_SQL}
SELECT d.source AS run_id, d.doc_id, {', '.join(
  f"CASE WHEN p.doc_id IS NULL THEN NULL WHEN reason IS NULL THEN human_{c} ELSE 'ERROR' END AS judge_{c}_verdict,"
  f" CASE WHEN p.doc_id IS NULL THEN NULL ELSE coalesce(reason, 'because ' || category) END AS judge_{c}_explanation"
  for c in CRITERIA)}
FROM documents d LEFT JOIN parsed p USING (doc_id)""")
def full_run_explained(spark, sf):
    """A full run: verdicts and explanations, those of failed replies included, replace what the sheet held."""
    stale = src.documents(spark, sf).select(
        F.col("source").alias("run_id"), "doc_id", F.lit("stale").alias(_EXPLAINED[0]))
    replies = _raw_verdicts(spark, sf).withColumn("latency_ms", F.lit(0.0))
    judged = rp.gate_replies(replies, "reply", "latency_ms").withColumns(
        {f"judge_{c}_explanation": F.col(f"{c}_explanation") for c in CRITERIA})
    return upsert(stale, judged, ["doc_id"], _EXPLAINED, mode="replace").select("run_id", "doc_id", *_EXPLAINED)


def _citing(spark, sf):
    """Answers citing the last line of their document, right, altered, refused or not at all."""
    docs = src.documents(spark, sf)
    last = F.element_at(F.split("text", "\n"), -1)
    events = src.latencies(spark, sf).select("doc_id", "event_type")
    quotes = docs.select("doc_id", F.col("source").alias("run_id"), last.alias("quote"))
    kind = F.col("event_type")
    reply = (
        F.when(kind == "purchase", F.concat(F.lit("As stated.\nReference: "), F.col("quote")))
        .when(kind == "view", F.concat(F.lit("Reference: "), F.col("quote"), F.lit(" [sic]")))
        .when(kind == "error", rp.REFUSAL)
        .when(kind == "signup", F.concat(F.lit("Reference:  "), F.upper("quote"), F.lit(" \n")))
        .otherwise("It is as the document says.")
    )
    return quotes.join(events, "doc_id").select("run_id", "doc_id", reply.alias("reply"))


def _cited(spark, sf):
    return rp.check_citations(_citing(spark, sf), src.documents(spark, sf), "doc_id", "reply", "text")


_LAST = "string_split(text, chr(10))[-1]"
_CITED_SQL = f"""cited AS (
  SELECT d.source AS run_id, d.doc_id, CASE
    WHEN event_type = 'error' THEN 'refused'
    WHEN event_type = 'click' THEN 'no_citation'
    WHEN event_type = 'view' THEN CASE
      WHEN contains(text, {src.sql_strip(f"({_LAST} || ' [sic]')")}) THEN 'supported' ELSE 'unsupported' END
    WHEN {src.sql_strip(_LAST)} = '' THEN 'no_citation'
    WHEN event_type = 'purchase' THEN 'supported'
    WHEN contains(text, {src.sql_strip(f'upper({_LAST})')}) THEN 'supported' ELSE 'unsupported' END AS outcome
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


@query(f"WITH {_CITED_SQL} SELECT run_id, doc_id, outcome FROM cited")
def citation_check(spark, sf):
    return _cited(spark, sf).select("run_id", "doc_id", "outcome")


@query(f"WITH {_CITED_SQL} SELECT outcome, count(*) AS n FROM cited GROUP BY outcome")
def citation_counts(spark, sf):
    return _cited(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH quoted AS (
  SELECT source AS run_id, doc_id, CASE event_type
    WHEN 'purchase' THEN {src.sql_strip(_LAST)} WHEN 'view' THEN {src.sql_strip(f"({_LAST} || ' [sic]')")}
    WHEN 'signup' THEN {src.sql_strip(f'upper({_LAST})')} END AS quote
  FROM documents JOIN events ON event_id = doc_id),
asked AS (SELECT DISTINCT quote FROM quoted WHERE quote <> ''),
places AS (
  SELECT quote, count(*) AS found_in, min(doc_id) AS first_doc FROM asked JOIN documents ON contains(text, quote) GROUP BY quote)
SELECT run_id, doc_id, coalesce(found_in, 0) AS found_in, first_doc
FROM quoted LEFT JOIN places USING (quote) WHERE quote <> ''""")
def citation_search(spark, sf):
    """Where the quotes of all replies stand, whatever document the reply names."""
    replies = stored(_citing(spark, sf), "replies")
    found = rp.search_citations(
        replies, src.documents(spark, sf), "doc_id", "reply", "text", lambda df: stored(df, "quotes"))
    return found.select("run_id", "doc_id", "found_in", "first_doc")

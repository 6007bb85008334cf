"""Answer sheets derived from the given tables, in Spark and in SQL.

The tables hold no lab data, so each operator runs on a stand-in:

* a run is a document source, its rows are documents, the category is the language;
* human verdicts come from ``labels`` (typing slips included), judge verdicts
  from measures of the whole document text;
* the answer latency is ``events.value * 50`` of the event with the document's
  number, and an ``error`` event marks a row whose judging failed;
* run B is the same answers with off-script words removed; a time-out (event
  value above 250) leaves no row in B, an ``error`` event none in A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.functions import text as tx
from answergauge.functions.bands import band
from answergauge.functions.verdicts import CRITERIA
from answergauge.sources.readers import read_table

# Limits of the derived judge verdicts.
FLUENCY_LIMITS = ((0.001, "good"), (0.05, "ok"))
GRAMMAR_LIMITS = ((20, "good"), (60, "ok"))
TONE_LIMITS = ((0, "good"), (5, "ok"))
LENGTH_LIMITS = ((2500, "good"), (6000, "ok"))
GROUNDING_LIMITS = ((0, "good"), (10, "ok"))

JUDGE = {c: f"judge_{c}" for c in CRITERIA}
PAIRS = {c: (f"human_{c}", f"judge_{c}") for c in CRITERIA}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def _by_label(poor: str, fair: str, clean_toxic: str, best: str) -> Column:
    quality, toxic = F.col("quality"), F.col("toxic")
    return (
        F.when((quality == 0) & (toxic == 1), poor)
        .when(quality == 0, fair)
        .when(toxic == 1, clean_toxic)
        .otherwise(best)
    )


def human_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select(
        "doc_id",
        _by_label("bad", "ok", "good", "good").alias("human_fluency"),
        _by_label("bda", "ok", "ok", "good").alias("human_grammar"),
        _by_label("bad", "good", "bda", "good").alias("human_tone"),
        _by_label("", "ok", "goood", "good").alias("human_length"),
        _by_label("bda", "bad", "ok", "good").alias("human_grounding"),
    )


def judge_ratings(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Verdicts measured on whole texts, computed before any join so that the
    shuffles downstream carry five short strings and no text. With ``only``, a
    table of doc_ids, nothing but their texts is measured."""
    text = F.col("text")
    docs = documents(spark, sf)
    if only is not None:
        docs = docs.join(only.select("doc_id"), "doc_id", "left_semi")
    # measures first: a band mentions its value once per limit
    measured = docs.select(
        "doc_id",
        F.col("source").alias("run_id"),
        F.col("lang").alias("category"),
        "n_chars",
        tx.off_script_share(text).alias("off_script"),
        tx.sentence_count(text).alias("sentences"),
        tx.occurrences(text, "!").alias("shouts"),
        tx.digit_count(text).alias("digits"),
    )
    return measured.select(
        "doc_id", "run_id", "category", "n_chars",
        band(F.col("off_script"), FLUENCY_LIMITS).alias("judge_fluency"),
        band(F.col("sentences"), GRAMMAR_LIMITS).alias("judge_grammar"),
        band(F.col("shouts"), TONE_LIMITS).alias("judge_tone"),
        band(F.col("n_chars"), LENGTH_LIMITS).alias("judge_length"),
        band(F.col("digits"), GROUNDING_LIMITS).alias("judge_grounding"),
    )


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"),
        (F.col("value") * 50).alias("latency_ms"),
        "value",
        "event_type",
    )


def rated_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with human and judge verdicts side by side."""
    return human_ratings(spark, sf).join(judge_ratings(spark, sf), "doc_id")


def judged_sheet(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Every answer (or those in ``only``) with its judge verdicts and latency."""
    timed = latencies(spark, sf).drop("value")
    return judge_ratings(spark, sf, only).join(timed, "doc_id", "left")


def full_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The judged sheet with human verdicts where rated."""
    return judged_sheet(spark, sf).join(human_ratings(spark, sf), "doc_id", "left")


def run_a(spark: SparkSession, sf: str) -> DataFrame:
    answered = latencies(spark, sf).where("event_type <> 'error'")
    return _as_run(documents(spark, sf).select("doc_id", "source", "lang", "text"), answered)


def run_b(spark: SparkSession, sf: str) -> DataFrame:
    in_time = latencies(spark, sf).where("value <= 250")
    cleaned = documents(spark, sf).select(
        "doc_id", "source", "lang", tx.drop_off_script_words(F.col("text")).alias("text"))
    return _as_run(cleaned, in_time)


def _as_run(texts: DataFrame, answered: DataFrame) -> DataFrame:
    """Text measures first, then the join: the text itself is not shuffled."""
    text = F.col("text")
    measured = texts.select(
        "doc_id",
        F.col("source").alias("run_id"),
        F.col("lang").alias("category"),
        tx.text_hash(text).alias("text_hash"),
        F.ceil(F.length(text) / 4).alias("tokens"),
        tx.sentence_count(text).alias("sentences"),
    )
    judged = measured.select(
        "doc_id", "run_id", "category", "text_hash", "tokens",
        band(F.col("sentences"), GRAMMAR_LIMITS).alias("verdict"))
    return judged.join(answered.select("doc_id", "latency_ms"), "doc_id")


# ---------------------------------------------------------------------------
# The same relations in SQL, as CTE bodies.
# ---------------------------------------------------------------------------

_WORD = r"[^\s]*[^\x00-\x7F][^\s]*"
_OUTER = r"^[\s\x0B\x1c-\x1f\x85\pZ]+|[\s\x0B\x1c-\x1f\x85\pZ]+$"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '{_OUTER}', '', 'g')"


def sql_clean(text: str) -> str:
    return sql_strip(
        f"regexp_replace(regexp_replace({text}, '{_WORD}', '', 'g'), ' +', ' ', 'g')")


def sql_sentences(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[.!?]+'))"


def sql_share(text: str) -> str:
    return (f"length(regexp_replace({text}, '[\\x00-\\x7F]+', '', 'g'))::DOUBLE"
            f" / nullif(length({text}), 0)")


def sql_repair(verdict: str) -> str:
    return (f"CASE nullif({verdict}, '') WHEN 'goood' THEN 'good' WHEN 'bda' THEN 'bad'"
            f" ELSE nullif({verdict}, '') END")


def sql_ordinal(verdict: str) -> str:
    return f"CASE {verdict} WHEN 'bad' THEN 0 WHEN 'ok' THEN 1 WHEN 'good' THEN 2 END"


def _sql_label(poor: str, fair: str, clean_toxic: str, best: str) -> str:
    return (f"CASE WHEN quality = 0 AND toxic = 1 THEN '{poor}' WHEN quality = 0 THEN '{fair}'"
            f" WHEN toxic = 1 THEN '{clean_toxic}' ELSE '{best}' END")


def sql_band(value: str, limits: tuple) -> str:
    (a, x), (b, y) = limits
    return f"CASE WHEN {value} <= {a} THEN '{x}' WHEN {value} <= {b} THEN '{y}' ELSE 'bad' END"


HUMAN_SQL = f"""human AS (
  SELECT doc_id,
    {_sql_label('bad', 'ok', 'good', 'good')} AS human_fluency,
    {_sql_label('bda', 'ok', 'ok', 'good')} AS human_grammar,
    {_sql_label('bad', 'good', 'bda', 'good')} AS human_tone,
    {_sql_label('', 'ok', 'goood', 'good')} AS human_length,
    {_sql_label('bda', 'bad', 'ok', 'good')} AS human_grounding
  FROM labels)"""

JUDGE_SQL = f"""judge AS (
  SELECT doc_id, source AS run_id, lang AS category, n_chars,
    {sql_band(sql_share('text'), FLUENCY_LIMITS)} AS judge_fluency,
    {sql_band(sql_sentences('text'), GRAMMAR_LIMITS)} AS judge_grammar,
    {sql_band("(length(text) - length(replace(text, '!', '')))", TONE_LIMITS)} AS judge_tone,
    {sql_band('n_chars', LENGTH_LIMITS)} AS judge_length,
    {sql_band("len(regexp_extract_all(text, '[0-9]'))", GROUNDING_LIMITS)} AS judge_grounding
  FROM documents)"""

RATED_SQL = f"""{HUMAN_SQL}, {JUDGE_SQL},
rated AS (SELECT * FROM human JOIN judge USING (doc_id))"""

PAIRS_SQL = RATED_SQL + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT run_id, doc_id, category, '{c}' AS criterion, {sql_repair('human_' + c)} AS human,"
    f" judge_{c} AS judge FROM rated" for c in CRITERIA
) + """), comparable AS (
  SELECT * FROM pairs WHERE human IN ('good', 'ok', 'bad') AND judge IN ('good', 'ok', 'bad'))"""

LATENCY_SQL = """latencies AS (
  SELECT event_id AS doc_id, value * 50 AS latency_ms, event_type FROM events)"""

SHEET_SQL = f"""{HUMAN_SQL}, {JUDGE_SQL}, {LATENCY_SQL},
sheet AS (SELECT * FROM judge LEFT JOIN latencies USING (doc_id) LEFT JOIN human USING (doc_id))"""

_CELLS = ", ".join(
    f"CASE WHEN coalesce(event_type = 'error', false) THEN 'ERROR' ELSE judge_{c} END"
    f" AS judge_{c}_verdict" for c in CRITERIA)
_ALL = [f"judge_{c}_verdict" for c in (*CRITERIA, "latency")]
_COUNT = {v: " + ".join(f"({c} = '{v}')::INT" for c in _ALL) for v in ("good", "bad")}

GATED_SQL = f"""{SHEET_SQL},
cells AS (
  SELECT * EXCLUDE ({', '.join(JUDGE.values())}), {_CELLS},
    CASE WHEN coalesce(event_type = 'error', false) THEN 'ERROR'
         WHEN latency_ms <= 2500 THEN 'good' WHEN latency_ms <= 6000 THEN 'ok'
         ELSE 'bad' END AS judge_latency_verdict
  FROM sheet),
gated AS (
  SELECT *, {_COUNT['good']} AS judge_good_count, {_COUNT['bad']} AS judge_bad_count,
    CASE WHEN judge_latency_verdict = 'ERROR' THEN 'ERROR'
         WHEN judge_grounding_verdict <> 'good' THEN 'fail'
         WHEN {_COUNT['good']} >= 4 AND {_COUNT['bad']} <= 1 THEN 'pass'
         ELSE 'fail' END AS judge_final_score
  FROM cells)"""


def _run_sql(name: str, text: str, condition: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, run_id, category, text_hash, tokens, verdict, value * 50 AS latency_ms
  FROM (SELECT doc_id, source AS run_id, lang AS category, sha256(t) AS text_hash,
               ceil(length(t) / 4.0)::BIGINT AS tokens,
               {sql_band(sql_sentences('t'), GRAMMAR_LIMITS)} AS verdict
        FROM (SELECT doc_id, source, lang, {text} AS t FROM documents))
  JOIN events ON event_id = doc_id WHERE {condition})"""


RUNS_SQL = (
    _run_sql("run_a", "text", "event_type <> 'error'") + ", "
    + _run_sql("run_b", sql_clean("text"), "value <= 250"))

"""Bands, range status, the pass/fail gate and the repair of judged sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.functions.bands import band, latency_band
from answergauge.functions.verdicts import CRITERIA, ERROR
from answergauge.operators import gate as gt
from answergauge.operators import ranges as rg
from answergauge.operators import runs as rn
from answergauge.operators import scorer
from answergauge.operators.numbering import first_rows, rows_at
from answergauge.operators.sampling import weekly_sample
from answergauge.plans import inputs as src
from answergauge.plans.registry import collector
from answergauge.session import shared_folder, written
from answergauge.sources.readers import read_table
from answergauge.streaming.live import corrected_pass_rate, monitor, windowed_pass_rate

QUERIES, query = collector()

# The valid range of each event type (errors have none), and the older rule whose
# stored status the audit compares with.
EVENT_RANGES = """SELECT event_type, CAST(low AS DOUBLE) AS reference_low, CAST(high AS DOUBLE) AS reference_high
FROM (VALUES ('click', 10.0, 200.0), ('view', 5.0, 150.0), ('purchase', 1.0, 100.0),
  ('signup', 20.0, 250.0)) AS t(event_type, low, high)"""
_RANGES_SQL = f"ranges AS ({EVENT_RANGES})"
_STATUS = "CASE WHEN reference_low IS NULL THEN 'no_range' WHEN value < reference_low OR value > reference_high THEN 'OOS' ELSE 'Pass' END"
_STORED = "CASE WHEN value > 200 THEN 'OOS' ELSE 'Pass' END"

JUDGED = [f"judge_{c}_verdict" for c in (*CRITERIA, "latency")]


def gated(spark, sf):
    return gt.gate(
        src.judged_sheet(spark, sf), src.JUDGE, "latency_ms", failed=F.col("event_type") == "error")


def _ranged(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "value")
    return rg.with_range_status(events, spark.sql(EVENT_RANGES), "event_type", "value")


@query(f"""WITH {_RANGES_SQL}
SELECT event_id, event_type, value, {_STATUS} AS status,
  value BETWEEN reference_low AND reference_high AS in_range
FROM events LEFT JOIN ranges USING (event_type)""")
def range_status(spark, sf):
    return _ranged(spark, sf).select("event_id", "event_type", "value", "status", "in_range")


@query(f"""WITH {_RANGES_SQL}, s AS (
  SELECT event_type, {_STATUS} AS status FROM events LEFT JOIN ranges USING (event_type))
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE status = 'no_range') AS n_no_range,
  count(*) FILTER (WHERE status = 'OOS') AS n_oos,
  round(avg(CASE WHEN status <> 'no_range' THEN (status = 'OOS')::INT END), 6) AS oos_rate
FROM s GROUP BY event_type""")
def range_status_rate(spark, sf):
    return rg.out_of_range_rate(_ranged(spark, sf), ["event_type"]).withColumn(
        "oos_rate", F.round("oos_rate", 6))


@query(f"""WITH {_RANGES_SQL}
SELECT event_id, event_type, value, {_STORED} AS stored_status, {_STATUS} AS status
FROM events LEFT JOIN ranges USING (event_type) WHERE {_STORED} <> {_STATUS}""")
def status_audit(spark, sf):
    stored = F.when(F.col("value") > 200, "OOS").otherwise("Pass")
    audited = rg.status_audit(_ranged(spark, sf).withColumn("stored_status", stored), "stored_status")
    return audited.select("event_id", "event_type", "value", "stored_status", "status")


@query("""SELECT CASE WHEN value * 50 <= 2500 THEN 'good' WHEN value * 50 <= 6000 THEN 'ok'
  ELSE 'bad' END AS latency_verdict, count(*) AS n FROM events GROUP BY 1""")
def latency_bands(spark, sf):
    banded = src.latencies(spark, sf).select(latency_band(F.col("latency_ms")).alias("latency_verdict"))
    return banded.groupBy("latency_verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(value) AS n, round(avg(value * 50), 6) AS mean_ms,
  round(max(value * 50), 6) AS max_ms, count(*) FILTER (WHERE value * 50 < 2000) AS n_under,
  round(avg((value * 50 < 2000)::INT), 6) AS share_under,
  count(*) FILTER (WHERE value * 50 > 10000) AS n_outliers
FROM events GROUP BY event_type""")
def latency_summary(spark, sf):
    summary = rn.latency_summary(src.latencies(spark, sf), ["event_type"], "latency_ms", 2000, 10000)
    return summary.withColumns({c: F.round(c, 6) for c in ("mean_ms", "max_ms", "share_under")})


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, doc_id, category, {', '.join(JUDGED)}, judge_good_count, judge_bad_count,
  judge_final_score FROM gated""")
def gate_rows(spark, sf):
    return gated(spark, sf).select(
        "run_id", "doc_id", "category", *JUDGED, "judge_good_count", "judge_bad_count",
        "judge_final_score")


@query(f"""WITH {src.GATED_SQL} SELECT judge_final_score, count(*) AS n FROM gated GROUP BY 1""")
def final_score_distribution(spark, sf):
    return gt.final_score_distribution(gated(spark, sf), "judge_final_score")


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE judge_final_score = 'pass') AS n_pass,
  round(avg((judge_final_score = 'pass')::INT), 6) AS pass_rate
FROM gated GROUP BY run_id""")
def pass_rate_by_run(spark, sf):
    return rn.pass_rate(gated(spark, sf), ["run_id"], "judge_final_score").withColumn(
        "pass_rate", F.round("pass_rate", 6))


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, category, grouping_id(run_id, category)::INT AS level, count(*) AS n,
  count(*) FILTER (WHERE judge_final_score = 'pass') AS n_pass,
  round(avg((judge_final_score = 'pass')::INT), 6) AS pass_rate
FROM gated GROUP BY ROLLUP (run_id, category)""")
def breakdown_by_category(spark, sf):
    return rn.breakdown(gated(spark, sf), "run_id", "category", "judge_final_score").withColumn(
        "pass_rate", F.round("pass_rate", 6))


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, doc_id, judge_grounding_verdict, judge_final_score
FROM gated WHERE judge_grounding_verdict IS DISTINCT FROM 'good'""")
def escalation_queue(spark, sf):
    return gt.escalation(gated(spark, sf), "judge_grounding_verdict").select(
        "run_id", "doc_id", "judge_grounding_verdict", "judge_final_score")


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, count(*) AS errors FROM gated WHERE judge_fluency_verdict = 'ERROR' GROUP BY run_id""")
def error_counts(spark, sf):
    return gt.error_counts(gated(spark, sf), "run_id", "judge_fluency_verdict")


CELLS = [*JUDGED, "judge_final_score"]


@query(f"""WITH {src.GATED_SQL}, retried AS (
  SELECT s.doc_id, s.judge_fluency, s.judge_grammar, s.judge_tone, s.judge_length, s.judge_grounding,
    s.latency_ms FROM sheet s WHERE s.latency_ms <= 10000),
second AS (
  SELECT doc_id, {', '.join(f'judge_{c} AS judge_{c}_verdict' for c in CRITERIA)},
    CASE WHEN latency_ms <= 2500 THEN 'good' WHEN latency_ms <= 6000 THEN 'ok' ELSE 'bad' END
      AS judge_latency_verdict FROM retried),
rescored AS (
  SELECT *, CASE WHEN judge_grounding_verdict <> 'good' THEN 'fail'
    WHEN {src._COUNT['good']} >= 4 AND {src._COUNT['bad']} <= 1 THEN 'pass'
    ELSE 'fail' END AS judge_final_score FROM second)
SELECT g.run_id, g.doc_id, {', '.join(
  f"CASE WHEN g.judge_fluency_verdict = 'ERROR' AND r.doc_id IS NOT NULL THEN r.{c} ELSE g.{c} END AS {c}"
  for c in CELLS)}
FROM gated g LEFT JOIN rescored r USING (doc_id)""")
def retry_upsert(spark, sf):
    """The retry answers only rows that come back within ten seconds; the rest stay ERROR."""
    sheet = written(gated(spark, sf).select("run_id", "doc_id", "latency_ms", *CELLS), "judged-sheet")
    open_rows = gt.errored(sheet, "judge_fluency_verdict").where("latency_ms <= 10000").select("doc_id", "latency_ms")
    rescored = gt.gate(
        src.judge_ratings(spark, sf, only=open_rows).join(open_rows, "doc_id"), src.JUDGE, "latency_ms")
    repaired = gt.retry_errors(sheet, rescored, ["doc_id"], CELLS, "judge_fluency_verdict")
    return repaired.select("run_id", "doc_id", *CELLS)


@query(f"""WITH {src.GATED_SQL}
SELECT run_id, doc_id, {', '.join(
  f"CASE WHEN nullif(human_length, '') IS NOT NULL THEN {c} END AS {c}" for c in CELLS)}
FROM gated""")
def subset_fill(spark, sf):
    """Judge columns for human-rated rows only (anchor: the length rating)."""
    rows = src.documents(spark, sf).select(F.col("source").alias("run_id"), "doc_id")
    anchor = src.human_ratings(spark, sf).select("doc_id", "human_length")
    rated = gt.rated(anchor, "human_length").select("doc_id")
    timed = src.judged_sheet(spark, sf, only=rated)
    scored = gt.gate(timed, src.JUDGE, "latency_ms", failed=F.col("event_type") == "error")
    sheet = rows.join(anchor, "doc_id", "left")
    return gt.judge_subset(sheet, scored, ["doc_id"], CELLS, "human_length").drop("human_length")


_NUMBERED = "row_number() OVER (PARTITION BY run_id ORDER BY doc_id) AS row_no"


@query(f"""WITH {src.RATED_SQL}, numbered AS (
  SELECT run_id, doc_id, {_NUMBERED} FROM judge)
SELECT n.run_id, n.row_no, n.doc_id, {', '.join(f'human_{c}, judge_{c}' for c in CRITERIA)}
FROM numbered n JOIN rated r USING (doc_id) WHERE n.row_no IN (1, 2, 5)""")
def spot_check(spark, sf):
    """Both raters side by side at chosen positions of every run."""
    wanted = [1, 2, 5]
    rows = src.documents(spark, sf).select(F.col("source").alias("run_id"), "doc_id")
    chosen = rows_at(first_rows(rows, "run_id", [F.col("doc_id")], max(wanted)), wanted)
    sheet = src.human_ratings(spark, sf).join(chosen, "doc_id")
    both = [x for c in CRITERIA for x in src.PAIRS[c]]
    judged = src.judge_ratings(spark, sf, only=sheet.select("doc_id")).drop("run_id")
    return sheet.join(judged, "doc_id").select("run_id", "row_no", "doc_id", *both)


@query(f"""SELECT run_id, row_no, doc_id, lang FROM (
  SELECT source AS run_id, doc_id, lang,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_no FROM documents)
WHERE row_no <= 5""")
def first_rows_per_run(spark, sf):
    rows = src.documents(spark, sf).select(F.col("source").alias("run_id"), "doc_id", "lang")
    return first_rows(rows, "run_id", [F.col("doc_id")], 5).select("run_id", "row_no", "doc_id", "lang")


@query("""SELECT week, audit_no, event_id, event_type FROM (
  SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_id, event_type, row_number() OVER (
    PARTITION BY date_trunc('week', ts) ORDER BY md5(event_id || '|audit'), event_id) AS audit_no
  FROM events) WHERE audit_no <= 25""")
def weekly_audit_sample(spark, sf):
    events = read_table(spark, sf, "events").select("ts", "event_id", "event_type")
    return weekly_sample(events, "ts", "event_id", 25, "audit").select(
        F.col("week").cast("timestamp_ntz").alias("week"), "audit_no", "event_id", "event_type")


def _rule(text: str) -> str:
    """A deterministic stand-in for the scoring service."""
    stops = sum(text.count(c) for c in ".!?")
    if not stops:
        raise ValueError("no sentence")
    return "good" if stops <= 20 else "ok" if stops <= 60 else "bad"


_STOPS = "len(regexp_extract_all(text, '[.!?]'))"


@query(f"""SELECT doc_id, source AS run_id,
  CASE WHEN {_STOPS} = 0 THEN 'ERROR' WHEN {_STOPS} <= 20 THEN 'good'
       WHEN {_STOPS} <= 60 THEN 'ok' ELSE 'bad' END AS verdict,
  CASE WHEN {_STOPS} = 0 THEN 'no sentence' END AS error
FROM documents""")
def bulk_score(spark, sf):
    answers = src.documents(spark, sf).withColumnRenamed("source", "run_id")
    return scorer.bulk_score(answers, ["doc_id", "run_id"], "text", _rule).select(
        "doc_id", "run_id", "verdict", "error")


@query(f"""SELECT doc_id, source AS run_id, CASE WHEN {_STOPS} = 0 THEN 2 ELSE 1 END AS attempt,
  CASE WHEN {_STOPS} = 0 THEN 'bad' WHEN {_STOPS} <= 20 THEN 'good' WHEN {_STOPS} <= 60 THEN 'ok' ELSE 'bad' END AS verdict
FROM documents""")
def bulk_score_resumed(spark, sf):
    """Scoring in three starts: all answers, the same again (nothing to do), and a retry of the errors."""
    folder = shared_folder(spark, "scoring")
    schema = src.documents(spark, sf).schema

    def arrived(path):
        stream = spark.readStream.schema(schema).parquet(path).withColumnRenamed("source", "run_id")
        return stream.withColumn("attempt", F.lit(1))

    keys = ["doc_id", "run_id", "attempt"]
    table = f"{sf}/{{documents}}.parquet"
    scorer.score_stream(arrived(table), keys, "text", _rule, folder)
    scores = scorer.score_stream(arrived(table), keys, "text", _rule, folder)
    answers = src.documents(spark, sf).withColumnRenamed("source", "run_id")
    again = scorer.next_attempts(scores, answers, keys[:2])
    retried = scorer.bulk_score(again, keys, "text", lambda text: "bad")
    return scorer.latest_scores(scores.unionByName(retried), keys[:2]).select(*keys, "verdict")


# Limits of the verdicts derived from streamed events.
LIVE_FLUENCY, LIVE_GRAMMAR = ((50, "good"), (80, "ok")), ((70, "good"), (90, "ok"))
LIVE_TONE = ((100, "good"), (200, "ok"))

def _live_sql(grounding: str) -> str:
    verdicts = (*CRITERIA, "latency")
    return f"""verdicts AS (
  SELECT ts::TIMESTAMP AS ts, event_type, value, {src.sql_band('k', LIVE_FLUENCY)} AS fluency,
    {src.sql_band('k', LIVE_GRAMMAR)} AS grammar, {src.sql_band('value', LIVE_TONE)} AS tone,
    CASE event_type WHEN 'view' THEN 'ok' ELSE 'good' END AS length, {grounding} AS grounding,
    CASE WHEN value * 50 <= 2500 THEN 'good' WHEN value * 50 <= 6000 THEN 'ok' ELSE 'bad' END AS latency
  FROM (SELECT *, (props::JSON ->> '$.k')::INT AS k FROM events)),
scored AS (SELECT ts, event_type, value, grounding = 'good'
    AND {' + '.join(f"({c} = 'good')::INT" for c in verdicts)} >= 4
    AND {' + '.join(f"({c} = 'bad')::INT" for c in verdicts)} <= 1 AS passed FROM verdicts)"""


_LIVE_SQL = f"""{_live_sql("CASE event_type WHEN 'error' THEN 'bad' ELSE 'good' END")},
w AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n,
    count(*) FILTER (WHERE passed) AS n_pass
  FROM scored GROUP BY 1)"""


@query(f"""WITH {_LIVE_SQL}
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, n, n_pass,
  round(n_pass / n, 6) AS pass_rate
FROM w WHERE window_start + INTERVAL '1 hour' <=
  (SELECT max(ts)::TIMESTAMP - INTERVAL '10 minutes' FROM events)""")
def live_pass_rate(spark, sf):
    """The gate on a stream: windows closed by the watermark once the events so far have passed."""
    schema = read_table(spark, sf, "events").schema
    # a pattern instead of a plain path: the table may be one file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{{events}}.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, value = F.col("event_type"), F.col("value")
    answers = stream.select(
        F.col("ts").cast("timestamp"),
        (value * 50).alias("latency_ms"),
        band(k, LIVE_FLUENCY).alias("fluency"),
        band(k, LIVE_GRAMMAR).alias("grammar"),
        band(value, LIVE_TONE).alias("tone"),
        F.when(kind == "view", "ok").otherwise("good").alias("length"),
        F.when(kind == "error", "bad").otherwise("good").alias("grounding"),
    )
    judged = gt.gate(answers, {c: c for c in CRITERIA}, "latency_ms")
    windows = windowed_pass_rate(judged, "ts", "judge_final_score", "1 hour", "10 minutes")
    out = monitor(spark, windows, shared_folder(spark, "live"))
    return out.withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"),
        "window_end": F.col("window_end").cast("timestamp_ntz"),
        "pass_rate": F.round("pass_rate", 6)})


@query(f"""WITH {_live_sql("'good'")},
w AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n,
    count(*) FILTER (WHERE passed AND (event_type <> 'error' OR value <= 200)) AS n_pass,
    count(*) FILTER (WHERE event_type = 'error' AND value > 200) AS n_errors,
    count(*) FILTER (WHERE event_type = 'error' AND value <= 200) AS n_corrected
  FROM scored GROUP BY 1)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, n, n_pass, n_errors, n_corrected,
  round(n_pass / n, 6) AS pass_rate
FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts)::TIMESTAMP - INTERVAL '30 minutes' FROM events)""")
def live_corrected_rate(spark, sf):
    """Errors first, their retries (within ten seconds) as further rows of the stream."""
    schema = read_table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{{events}}.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, value = F.col("event_type"), F.col("value")
    attempts = F.when(kind == "error", F.when(value <= 200, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).otherwise(
        F.array(F.lit(2)))
    answers = stream.select(
        "event_id", F.col("ts").cast("timestamp"), F.explode(attempts).alias("attempt"),
        (value * 50).alias("latency_ms"),
        band(k, LIVE_FLUENCY).alias("fluency"), band(k, LIVE_GRAMMAR).alias("grammar"), band(value, LIVE_TONE).alias("tone"),
        F.when(kind == "view", "ok").otherwise("good").alias("length"), F.lit("good").alias("grounding"))
    judged = gt.gate(answers, {c: c for c in CRITERIA}, "latency_ms", failed=F.col("attempt") == 1)
    scored = judged.withColumn(
        "score", F.when(F.col("attempt") == 1, ERROR).otherwise(F.col("judge_final_score")))
    windows = corrected_pass_rate(scored, ["event_id"], "ts", "attempt", "score", "1 hour", "30 minutes")
    out = monitor(spark, windows, shared_folder(spark, "live"))
    return out.withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"),
        "window_end": F.col("window_end").cast("timestamp_ntz"),
        "pass_rate": F.round("pass_rate", 6)})

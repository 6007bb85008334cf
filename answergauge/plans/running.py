"""Run against run, cost and capacity, sheets on disk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from answergauge.functions.verdicts import CRITERIA, repair
from answergauge.operators import runs as rn
from answergauge.operators.agreement import agreement, pair_columns
from answergauge.operators.gate import gate, rated
from answergauge.operators.numbering import number_rows
from answergauge.plans import inputs as src
from answergauge.plans.gating import JUDGED, gated
from answergauge.plans.registry import collector
from answergauge.session import shared_folder
from answergauge.sources import readers, writers

QUERIES, query = collector()

# Prices in currency per million tokens, by answer language; Spanish has none.
PRICES = """SELECT lang, CAST(price_in AS DOUBLE) AS price_in, CAST(price_out AS DOUBLE) AS price_out
FROM (VALUES ('en', 2, 10), ('fr', 3, 15), ('de', 1, 5)) AS t(lang, price_in, price_out)"""
BASELINE = "src0"
KEYS = ["run_id", "doc_id"]


@query("SELECT source AS run_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_no"
       " FROM documents")
def numbered_rows(spark, sf):
    rows = src.documents(spark, sf).select(F.col("source").alias("run_id"), "doc_id")
    return number_rows(rows, "run_id", "doc_id")


def _melted(spark, sf):
    return rn.melt(
        gated(spark, sf), ["run_id"], {c: f"judge_{c}_verdict" for c in (*CRITERIA, "latency")})


_MELTED_SQL = src.GATED_SQL + ", melted AS (" + " UNION ALL ".join(
    f"SELECT run_id, '{c}' AS criterion, judge_{c}_verdict AS verdict FROM gated"
    for c in (*CRITERIA, "latency")) + """),
distribution AS (SELECT run_id, criterion,
  count(*) FILTER (WHERE verdict = 'good') AS n_good, count(*) FILTER (WHERE verdict = 'ok') AS n_ok,
  count(*) FILTER (WHERE verdict = 'bad') AS n_bad,
  count(*) FILTER (WHERE verdict IS NULL OR verdict NOT IN ('good', 'ok', 'bad')) AS n_other
FROM melted GROUP BY ALL)"""


@query(f"WITH {_MELTED_SQL} SELECT * FROM distribution")
def verdict_distribution(spark, sf):
    return rn.verdict_distribution(_melted(spark, sf), ["run_id", "criterion"])


@query(f"""WITH {_MELTED_SQL} SELECT d.*, b.n_good AS base_good, d.n_good - b.n_good AS delta_good
FROM distribution d LEFT JOIN distribution b ON b.criterion = d.criterion AND b.run_id = '{BASELINE}'""")
def delta_vs_baseline(spark, sf):
    distribution = rn.verdict_distribution(_melted(spark, sf), ["run_id", "criterion"])
    return rn.delta_vs_baseline(distribution, "run_id", BASELINE, "criterion")


def _aligned(spark, sf, *columns):
    return rn.align_runs(
        src.run_a(spark, sf), src.run_b(spark, sf), ["doc_id"], list(columns), carry=["run_id"])


_STATUS = """CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right'
  WHEN a.text_hash = b.text_hash THEN 'unchanged' ELSE 'changed' END"""
_ALIGNED = "run_a a FULL JOIN run_b b ON a.run_id = b.run_id AND a.doc_id = b.doc_id"


@query(f"""WITH {src.RUNS_SQL} SELECT coalesce(a.run_id, b.run_id) AS run_id,
  coalesce(a.doc_id, b.doc_id) AS doc_id, a.tokens AS tokens_a, b.tokens AS tokens_b, {_STATUS} AS status
FROM {_ALIGNED}""")
def run_text_diff(spark, sf):
    return _aligned(spark, sf, "text_hash", "tokens").select(
        *KEYS, "tokens_a", "tokens_b", rn.diff_status().alias("status"))


@query(f"""WITH {src.RUNS_SQL} SELECT run_id, count(*) AS n, count(*) FILTER (WHERE tokens > 375) AS n_over,
  count(*) FILTER (WHERE tokens = 375) AS n_at_cap FROM run_a GROUP BY run_id""")
def token_cap_counts(spark, sf):
    return rn.token_cap_counts(src.run_a(spark, sf), ["run_id"], "tokens", 375)


@query(f"""WITH {src.RUNS_SQL} SELECT run_id, doc_id, text_hash FROM run_a
INTERSECT SELECT run_id, doc_id, text_hash FROM run_b""")
def unchanged_rows(spark, sf):
    return rn.unchanged_rows(src.run_a(spark, sf), src.run_b(spark, sf), [*KEYS, "text_hash"])


@query(f"""WITH {src.RUNS_SQL}
(SELECT run_id, doc_id, text_hash, 'left' AS side, 1::BIGINT AS n FROM run_a
  WHERE (doc_id, text_hash) NOT IN (SELECT (doc_id, text_hash) FROM run_b))
UNION ALL
(SELECT run_id, doc_id, text_hash, 'right', 1 FROM run_b
  WHERE (doc_id, text_hash) NOT IN (SELECT (doc_id, text_hash) FROM run_a))""")
def changed_rows(spark, sf):
    return rn.changed_rows(src.run_a(spark, sf), src.run_b(spark, sf), [*KEYS, "text_hash"])


@query(f"""WITH {src.RUNS_SQL} SELECT a.run_id, a.doc_id FROM run_a a JOIN run_b b USING (doc_id)
WHERE a.text_hash <> b.text_hash AND a.doc_id NOT IN (SELECT doc_id FROM labels)""")
def changed_unrated(spark, sf):
    aligned = _aligned(spark, sf, "text_hash")
    changed = aligned.where(rn.diff_status() == "changed").select(*KEYS)
    return rn.changed_but_unrated(changed, src.human_ratings(spark, sf), ["doc_id"]).select(*KEYS)


@query(f"""WITH {src.RUNS_SQL} SELECT run_id, doc_id FROM run_a
WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM run_b)""")
def rated_in_both(spark, sf):
    scored = src.run_a(spark, sf).join(src.human_ratings(spark, sf), "doc_id", "left_semi")
    return rn.rated_in_both(scored, src.run_b(spark, sf), ["doc_id"]).select(*KEYS)


@query(f"""WITH {src.RUNS_SQL},
a AS (SELECT run_id, avg(tokens) AS old_tokens, avg(latency_ms) AS old_latency_ms FROM run_a GROUP BY 1),
b AS (SELECT run_id, avg(tokens) AS new_tokens, avg(latency_ms) AS new_latency_ms FROM run_b GROUP BY 1)
SELECT run_id, round((new_tokens - old_tokens) / old_tokens, 6) AS change_tokens,
  round((new_latency_ms - old_latency_ms) / old_latency_ms, 6) AS change_latency_ms
FROM a FULL JOIN b USING (run_id)""")
def relative_change(spark, sf):
    change = rn.relative_change(
        src.run_a(spark, sf), src.run_b(spark, sf), ["run_id"], ["tokens", "latency_ms"])
    return change.select(
        "run_id", F.round("change_tokens", 6).alias("change_tokens"),
        F.round("change_latency_ms", 6).alias("change_latency_ms"))


@query(f"""WITH {src.RUNS_SQL} SELECT a.run_id, a.verdict AS from_verdict, b.verdict AS to_verdict,
  count(*) AS n FROM run_a a JOIN run_b b USING (doc_id) GROUP BY ALL""")
def verdict_transitions(spark, sf):
    return rn.transitions(_aligned(spark, sf, "verdict"), ["run_id"], "verdict")


@query(f"""WITH {src.RUNS_SQL} SELECT a.run_id, a.doc_id, a.verdict AS verdict_a, b.verdict AS verdict_b
FROM run_a a JOIN run_b b USING (doc_id) WHERE a.verdict <> b.verdict""")
def verdict_flips(spark, sf):
    return rn.flips(_aligned(spark, sf, "verdict"), "verdict").select(*KEYS, "verdict_a", "verdict_b")


@query(f"""WITH {src.RUNS_SQL}
SELECT *, 'A' AS source_run FROM run_a UNION ALL SELECT *, 'B' FROM run_b""")
def union_runs(spark, sf):
    return rn.stack_runs({"A": src.run_a(spark, sf), "B": src.run_b(spark, sf)})


def _rated_texts(spark, sf):
    """Every document with its text hash and, where rated, the repaired grounding verdict."""
    hashed = rn.with_text_hash(src.documents(spark, sf), ["doc_id"], "text")
    ratings = src.human_ratings(spark, sf).select(
        "doc_id", repair(F.col("human_grounding")).alias("verdict"))
    return hashed.join(ratings, "doc_id", "left")


_TEXTS_SQL = f"""{src.HUMAN_SQL}, texts AS (
  SELECT doc_id, sha256(text) AS text_hash, {src.sql_repair('human_grounding')} AS verdict
  FROM documents LEFT JOIN human USING (doc_id))"""


@query(f"""WITH {src.HUMAN_SQL}, texts AS (
  SELECT sha256(text) AS text_hash, human.* FROM documents JOIN human USING (doc_id)),
cells AS (""" + " UNION ALL ".join(
    f"SELECT text_hash, '{c}' AS criterion, {src.sql_repair('human_' + c)} AS verdict FROM texts" for c in CRITERIA) + """)
SELECT text_hash, criterion, count(*) AS n, count(DISTINCT verdict) AS distinct_verdicts
FROM cells WHERE verdict IN ('good', 'ok', 'bad') GROUP BY ALL HAVING count(*) >= 2""")
def rating_drift(spark, sf):
    """Copies of a text and how differently they were rated, for every criterion."""
    hashed = rn.with_text_hash(src.documents(spark, sf), ["doc_id"], "text")
    ratings = src.human_ratings(spark, sf).withColumns(
        {f"human_{c}": repair(F.col(f"human_{c}")) for c in CRITERIA})
    melted = rn.melt(
        hashed.join(ratings, "doc_id"), ["text_hash"], {c: f"human_{c}" for c in CRITERIA})
    return rn.rating_drift(melted, "text_hash", ["criterion"])


@query(f"""WITH {_TEXTS_SQL}, known AS (
  SELECT text_hash, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS carried_verdict
  FROM texts GROUP BY text_hash)
SELECT doc_id, text_hash, carried_verdict FROM texts JOIN known USING (text_hash) WHERE verdict IS NULL""")
def rating_carryover(spark, sf):
    return rn.carry_ratings(_rated_texts(spark, sf), "doc_id", "text_hash", "verdict").select(
        "doc_id", "text_hash", "carried_verdict")


_COST = "(ceil(n_chars / 4.0) * price_in + ceil(n_chars / 16.0) * price_out) / 1e6"


@query(f"""WITH prices AS ({PRICES})
SELECT source AS run_id, count(*) AS n, count(*) FILTER (WHERE price_in IS NULL) AS n_unpriced, sum(ceil(n_chars / 4.0))::BIGINT AS input_tokens,
  sum(ceil(n_chars / 16.0))::BIGINT AS output_tokens, round(sum({_COST}), 6) AS cost,
  round(avg({_COST}), 6) AS cost_per_row
FROM documents LEFT JOIN prices USING (lang) GROUP BY source""")
def cost_by_run(spark, sf):
    usage = src.documents(spark, sf).select(
        F.col("source").alias("run_id"), "lang",
        F.ceil(F.col("n_chars") / 4).alias("input_tokens"),
        F.ceil(F.col("n_chars") / 16).alias("output_tokens"))
    return rn.cost_by(usage, spark.sql(PRICES), "lang", ["run_id"]).withColumns(
        {c: F.round(c, 6) for c in ("cost", "cost_per_row")})


@query("""SELECT event_type, count(*) AS n, round(sum(value * 50 / 1000), 4) AS elapsed_s,
  round(avg(value * 50 / 1000), 6) AS seconds_per_row,
  round(avg(value * 50 / 1000) * 5000 / 3600, 6) AS hours_for_volume
FROM events GROUP BY event_type""")
def capacity_hours(spark, sf):
    timed = src.latencies(spark, sf).withColumn("elapsed_s", F.col("latency_ms") / 1000)
    return rn.capacity(timed, ["event_type"], "elapsed_s", 5000).withColumns({
        "elapsed_s": F.round("elapsed_s", 4),
        "seconds_per_row": F.round("seconds_per_row", 6),
        "hours_for_volume": F.round("hours_for_volume", 6)})


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf):
    """The fact table written as CSV and read back with its stated types."""
    parts = readers.read_table(spark, sf, "part")
    path = shared_folder(spark, "csv")
    writers.write_csv(parts, path)
    return readers.read_csv(
        spark, path, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, "
        "p_size INT, p_retailprice DOUBLE")


@query("SELECT event_id, event_type, ts::TIMESTAMP AS ts, value FROM events")
def csv_timestamps(spark, sf):
    """Timestamps to the microsecond through CSV."""
    events = readers.read_table(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = shared_folder(spark, "csv")
    writers.write_csv(events, path)
    back = readers.read_csv(spark, path, "event_id BIGINT, event_type STRING, ts TIMESTAMP, value DOUBLE")
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT item_id, md5(text || chr(10)) AS text_md5, length(text) + 1 AS chars FROM benchmark")
def whole_text_scan(spark, sf):
    """Each text as a file of its own, read back whole."""
    path = shared_folder(spark, "texts")
    readers.read_table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    found = readers.read_documents(spark, f"{path}/*/*.txt")
    return found.select(
        F.regexp_extract("path", "item_id=([0-9]+)/", 1).cast("bigint").alias("item_id"),
        F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, sf):
    """Texts with newlines and accents through JSON lines."""
    turns = readers.read_table(spark, sf, "conversations")
    path = shared_folder(spark, "jsonl")
    writers.write_jsonl(turns, path)
    return readers.read_jsonl(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


# runs named by digits, some with a leading zero: 7 and 07 are different runs
_DIGITS = "regexp_replace(run_id, '[a-z]+', '')"
_NAMED = f"CASE WHEN doc_id % 2 = 0 THEN '0' || {_DIGITS} ELSE {_DIGITS} END"


@query(f"""WITH {src.GATED_SQL}
SELECT {_NAMED} AS run_id, doc_id, {', '.join(JUDGED)}, judge_final_score FROM gated""")
def run_sheet_versions(spark, sf):
    """Judge a sheet read from version 1 and write it as version 2 of the same folder."""
    folder = shared_folder(spark, "sheets")
    writers.write_run_sheets(src.full_sheet(spark, sf).withColumn("run_id", F.expr(_NAMED)), folder, "01")
    first = readers.read_run_sheets(spark, folder, version="01")
    judged = gate(first, src.JUDGE, "latency_ms", failed=F.col("event_type") == "error")
    writers.write_run_sheets(
        judged.select("run_id", "doc_id", *JUDGED, "judge_final_score"), folder, "02")
    return readers.read_run_sheets(spark, folder).select(
        "run_id", "doc_id", *JUDGED, "judge_final_score")


@query(f"""WITH {src.SHEET_SQL}
SELECT {_NAMED} AS run_id, doc_id, judge_fluency FROM sheet WHERE {_NAMED} = '07'""")
def single_run_sheet(spark, sf):
    """One stored run, read by its id."""
    folder = shared_folder(spark, "sheets")
    writers.write_run_sheets(src.judged_sheet(spark, sf).withColumn("run_id", F.expr(_NAMED)), folder, "1")
    return readers.read_run_sheets(spark, folder, run_id="07").select("run_id", "doc_id", "judge_fluency")


@query("""SELECT source AS run_id, count(*) AS saved_rows, count(l.doc_id) AS rated_rows
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def row_totals(spark, sf):
    """Saved and rated rows per run."""
    rows = src.documents(spark, sf).select(F.col("source").alias("run_id"), "doc_id")
    marks = src.human_ratings(spark, sf).select("doc_id", F.lit(1).alias("rated"))
    return rows.join(marks, "doc_id", "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("saved_rows"), F.count("rated").alias("rated_rows"))


@query(f"""WITH {src.PAIRS_SQL} SELECT c.run_id, c.criterion, count(*) AS n,
  round(avg((human = judge)::INT), 6) AS agreement
FROM comparable c JOIN rated r USING (doc_id)
WHERE nullif(r.human_length, '') IS NOT NULL GROUP BY ALL""")
def sheet_agreement(spark, sf):
    """Stored sheets of all runs, their rated rows (anchor: length), agreement per run."""
    folder = shared_folder(spark, "sheets")
    writers.write_run_sheets(src.full_sheet(spark, sf), folder, "1")
    rows = rated(readers.read_run_sheets(spark, folder, version="1"), "human_length")
    pairs = pair_columns(rows, ["run_id", "doc_id"], src.PAIRS)
    return agreement(pairs, ["run_id", "criterion"]).select(
        "run_id", "criterion", "n", F.round("agreement", 6).alias("agreement"))


# every 7th event has a text for a value, every 11th lacks its last cell, every 13th has one too many
_DAMAGE = """CASE WHEN event_id % 11 = 0 THEN 'wrong number of cells' WHEN event_id % 13 = 0 THEN 'wrong number of cells'
  WHEN event_id % 7 = 0 THEN 'value is not double' END"""


def _damaged(spark, sf):
    """Events as CSV lines, some of them unreadable, read with their rejects."""
    e = F.col("event_id")
    value = F.when(e % 7 == 0, F.concat(F.lit("n/a "), F.col("value"))).otherwise(F.col("value").cast("string"))
    line = F.when(e % 11 == 0, F.concat_ws(",", e, "event_type")).when(
        e % 13 == 0, F.concat_ws(",", e, "event_type", value, F.lit("extra"))).otherwise(F.concat_ws(",", e, "event_type", value))
    events = readers.read_table(spark, sf, "events").select(line.alias("event_id,event_type,value"))
    path = shared_folder(spark, "damaged")
    # one text column without quoting; each file starts with its name, as a header line
    events.write.option("header", "true").option("quote", "").option("sep", "\t").csv(path)
    return readers.with_rejects(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query(f"""SELECT coalesce({_DAMAGE}, 'good') AS outcome, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM events GROUP BY 1""")
def csv_rejects(spark, sf):
    """Good rows and rejects by reason; the counts add up to the lines."""
    read = _damaged(spark, sf)
    good = readers.good_rows(read).select(F.lit("good").alias("outcome"), "event_id")
    bad = readers.rejects(read).select(
        F.col("reason").alias("outcome"), F.substring_index("record", ",", 1).cast("bigint").alias("event_id"))
    return good.unionByName(bad).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"""WITH numbered AS (
  SELECT doc_id, list_transform(string_split(replace(text, chr(13), ' '), chr(10)), lambda x: x) AS lines FROM documents),
pieces AS (SELECT doc_id, 0 AS clause_no, '== document ' || doc_id AS clause FROM numbered
  UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)), unnest(list_transform(lines, lambda x: '- ' || x)) FROM numbered)
SELECT doc_id, clause_no, md5(clause) AS clause_md5, length(clause) AS clause_chars FROM pieces""")
def large_file_sections(spark, sf):
    """All documents in a few large text files, cut into sections and clauses by byte ranges."""
    clean = F.regexp_replace("text", "\r", " ")
    text = F.concat(F.lit("== document "), "doc_id", F.lit("\n- "), F.regexp_replace(clean, "\n", "\n- "))
    path = shared_folder(spark, "large")
    src.documents(spark, sf).select(text.alias("value")).write.text(path)
    found = readers.read_sections(spark, path, heading=r"^== document \d+$", clause="^- ")
    titles = F.first(F.when(F.col("clause_no") == 0, F.regexp_extract("text", r"(\d+)$", 1)), ignorenulls=True)
    title = titles.over(Window.partitionBy("path", "section_no"))
    return found.select(
        title.cast("bigint").alias("doc_id"), "clause_no", F.md5("text").alias("clause_md5"),
        F.length("text").alias("clause_chars"))

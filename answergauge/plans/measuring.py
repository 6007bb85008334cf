"""Latency percentiles, tested biases, deep positions and large samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.operators import quantiles as qt
from answergauge.operators.agreement import bias_alarm_tested as tested_biases
from answergauge.operators.agreement import pair_columns
from answergauge.operators.numbering import rows_at_positions
from answergauge.operators.sampling import sample_large
from answergauge.plans import inputs as src
from answergauge.plans.registry import collector
from answergauge.session import written
from answergauge.sources.readers import read_table

QUERIES, query = collector()

# The percentiles of the latency report.
SHARES = (0.5, 0.95, 0.99)


def _timed(spark, sf):
    """Answers with their run, language and latency; narrow."""
    answers = src.documents(spark, sf).select("doc_id", F.col("source").alias("run_id"), F.col("lang").alias("category"))
    return answers.join(src.latencies(spark, sf).select("doc_id", "latency_ms"), "doc_id")


_TIMED_SQL = """timed AS (
  SELECT doc_id, source AS run_id, lang AS category, value * 50 AS latency_ms
  FROM documents JOIN events ON event_id = doc_id WHERE value IS NOT NULL AND NOT isnan(value))"""


@query(f"""WITH {_TIMED_SQL}, ranked AS (
  SELECT run_id, latency_ms, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) AS rank,
    count(*) OVER (PARTITION BY run_id) AS n FROM timed)
SELECT run_id, max(n) AS n, """ + ", ".join(
    f"max(latency_ms) FILTER (WHERE rank = greatest(1, ceil({s}::DOUBLE * n))) AS p{s * 100:g}" for s in SHARES) + """
FROM ranked GROUP BY run_id""")
def latency_percentiles(spark, sf):
    """Exact percentiles per run, found by narrowing the buckets of the runs' sketches."""
    found = qt.exact_quantiles(_timed(spark, sf), ["run_id"], "latency_ms", SHARES, lambda df: written(df, "ranges"))
    return qt.in_columns(found, ["run_id"], SHARES, "value")


_BUCKET = (f"CASE WHEN latency_ms > 0 THEN floor(log2(abs(latency_ms)) * {qt.STEPS})::BIGINT + {qt.DOUBLINGS * qt.STEPS}"
           f" WHEN latency_ms < 0 THEN -(floor(log2(abs(latency_ms)) * {qt.STEPS})::BIGINT + {qt.DOUBLINGS * qt.STEPS}) ELSE 0 END")


@query(f"""WITH {_TIMED_SQL}, sketch AS (
  SELECT category, {_BUCKET} AS bucket, count(*) AS n, min(latency_ms) AS low, max(latency_ms) AS high
  FROM timed GROUP BY 1, 2),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY category ORDER BY bucket)::BIGINT AS upto,
    sum(n) OVER (PARTITION BY category)::BIGINT AS total FROM sketch)
SELECT category, max(total) AS n, """ + ", ".join(
    f"max({v}) FILTER (WHERE greatest(1, ceil({s}::DOUBLE * total)) BETWEEN upto - n + 1 AND upto) AS p{s * 100:g}_{c}"
    for s in SHARES for v, c in (("low", "low"), ("high", "high"), ("round(n / total, 9)", "rank_error"))) + """
FROM ranked GROUP BY category""")
def latency_percentiles_merged(spark, sf):
    """Percentiles per language from sketches stored per run: the answers are not read again."""
    per_run = written(qt.quantile_sketch(_timed(spark, sf), ["run_id", "category"], "latency_ms"), "latency-sketches")
    merged = qt.merge_sketches(per_run, ["category"])
    bounds = qt.sketch_quantiles(merged, ["category"], SHARES).withColumn("rank_error", F.round("rank_error", 9))
    return qt.in_columns(bounds, ["category"], SHARES, "low", "high", "rank_error")


_GAP = f"({src.sql_ordinal('judge')}) - ({src.sql_ordinal('human')})"


@query(f"""WITH {src.PAIRS_SQL}, signs AS (
  SELECT category, criterion, count(*) AS n, count(*) FILTER (WHERE {_GAP} > 0) AS more_generous,
    count(*) FILTER (WHERE {_GAP} < 0) AS harsher FROM comparable GROUP BY ALL),
tests AS (
  SELECT *, least(1.0, 2 * list_sum(list_transform(range(0, least(more_generous, harsher) + 1), lambda i:
      exp(lgamma(more_generous + harsher + 1) - lgamma(i + 1) - lgamma(more_generous + harsher - i + 1)
        - (more_generous + harsher) * ln(2))))) AS p_value FROM signs),
steps AS (
  SELECT *, least(1.0, p_value * (count(*) OVER (PARTITION BY category)
      - row_number() OVER (PARTITION BY category ORDER BY p_value) + 1)) AS step FROM tests),
adjusted AS (SELECT *, max(step) OVER (PARTITION BY category ORDER BY p_value) AS p_adjusted FROM steps)
SELECT category, criterion, n, more_generous, harsher, round(p_value + 1e-12, 9) AS p_value, round(p_adjusted + 1e-12, 9) AS p_adjusted,
  p_adjusted <= 0.05 AS alarm FROM adjusted""")
def bias_alarm_tested(spark, sf):
    """Biases per language, tested for each criterion, corrected over the five criteria of a language."""
    pairs = pair_columns(src.rated_sheet(spark, sf), ["category", "doc_id"], src.PAIRS)
    return tested_biases(pairs, ["category"], ["criterion"]).select(
        "category", "criterion", "n", "more_generous", "harsher", *(F.round(F.col(p) + 1e-12, 9).alias(p) for p in ("p_value", "p_adjusted")), "alarm")


# Positions wanted of every run, and bits of a key bucket.
DEPTHS = [1, 777, 5_000, 20_000, 100_000]
DEPTH_BITS = 12


@query(f"""SELECT run_id, line_id, row_no FROM (
  SELECT l_returnflag || l_linestatus AS run_id, l_orderkey * 8 + l_linenumber AS line_id,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_orderkey * 8 + l_linenumber) AS row_no
  FROM lineitem) WHERE row_no IN ({', '.join(map(str, DEPTHS))})""")
def rows_at_depth(spark, sf):
    """Lines at chosen positions of runs of very different length."""
    lines = read_table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"))
    return rows_at_positions(lines, "run_id", "line_id", DEPTHS, bits=DEPTH_BITS)


_SAMPLED = "md5((l_orderkey * 8 + l_linenumber) || '|seed')"


@query(f"""SELECT line_id, quantity FROM (
  SELECT l_orderkey * 8 + l_linenumber AS line_id, l_quantity AS quantity,
    row_number() OVER (ORDER BY {_SAMPLED}, l_orderkey * 8 + l_linenumber) AS place FROM lineitem)
WHERE place <= 20000""")
def large_sample(spark, sf):
    """Twenty thousand lines without replacement."""
    lines = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), F.col("l_quantity").alias("quantity"))
    return sample_large(lines, "line_id", 20_000, "seed")


@query(f"""SELECT run_id, line_id FROM (
  SELECT l_returnflag || l_linestatus AS run_id, l_orderkey * 8 + l_linenumber AS line_id,
    row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {_SAMPLED}, l_orderkey * 8 + l_linenumber) AS place
  FROM lineitem) WHERE place <= 3000""")
def large_sample_per_run(spark, sf):
    """Three thousand lines of every run, or all of a shorter one."""
    lines = read_table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"))
    return sample_large(lines, "line_id", 3_000, "seed", by=["run_id"]).select("run_id", "line_id")

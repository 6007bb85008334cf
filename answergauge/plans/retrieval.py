"""Questions, the facts they name, and request texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.operators import golden as gd
from answergauge.operators import retrieve as rt
from answergauge.operators.ranges import with_range_status
from answergauge.operators.sampling import sample_exact
from answergauge.plans.registry import collector
from answergauge.sources.readers import read_table

QUERIES, query = collector()

# The id pattern of page questions (no right boundary, so a longer
# number yields its first three digits), of part questions, and the part ranges.
PAGE_ID, PART_ID = "[0-9]{3}", "P-[0-9]+"
PART_RANGES = """SELECT p_type, CAST(low AS DOUBLE) AS reference_low, CAST(high AS DOUBLE) AS reference_high
FROM (VALUES ('STANDARD', 5, 40), ('ECONOMY', 1, 30), ('PROMO', 10, 50),
  ('SMALL', 1, 20), ('LARGE', 25, 50), ('MEDIUM', 10, 35)) AS t(p_type, low, high)"""
FACT_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _questions(spark, sf, expected=False):
    pages = read_table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("question"),
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("category"),
        F.col("page_id").cast("string").alias("expected_id"))
    return rt.with_ids(pages, "question", PAGE_ID, "expected_id" if expected else None)


def _parts(spark, sf):
    return read_table(spark, sf, "part").select(*FACT_COLUMNS)


def ranged_parts(spark, sf):
    parts = read_table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_type", F.col("p_size").cast("double").alias("size"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("part_id"),
        F.lit("cm").alias("unit"))
    return with_range_status(parts, spark.sql(PART_RANGES), "p_type", "size")


def golden(spark, sf):
    return gd.golden_set(
        ranged_parts(spark, sf), "p_partkey", "part_id", "p_name", "size", "unit", seed="42")


_IDS = f"list_distinct(regexp_extract_all(url, '{PAGE_ID}'))"


def _wanted(ids: str) -> str:
    return f"""q AS (SELECT page_id, url, {ids} AS ids FROM pages),
w AS (SELECT page_id, unnest(ids)::BIGINT AS id FROM q)"""


_RETRIEVE = """SELECT page_id, 'IDS' AS context_ref, {columns}
FROM w JOIN part ON p_partkey = id
UNION ALL SELECT page_id, 'ALL', {nulls} FROM q WHERE len(ids) = 0""".format(
    columns=", ".join(FACT_COLUMNS), nulls=", ".join(["NULL"] * len(FACT_COLUMNS)))


@query(f"WITH {_wanted(_IDS)} {_RETRIEVE}")
def retrieve_facts(spark, sf):
    return rt.retrieve(_questions(spark, sf), "page_id", _parts(spark, sf), "p_partkey").select(
        "page_id", "context_ref", *FACT_COLUMNS)


_WITH_EXPECTED = (f"CASE WHEN list_contains({_IDS}, page_id::VARCHAR) THEN {_IDS}"
                  f" ELSE list_append({_IDS}, page_id::VARCHAR) END")


@query(f"WITH {_wanted(_WITH_EXPECTED)} {_RETRIEVE}")
def retrieve_with_expected(spark, sf):
    questions = _questions(spark, sf, expected=True)
    return rt.retrieve(questions, "page_id", _parts(spark, sf), "p_partkey").select(
        "page_id", "context_ref", *FACT_COLUMNS)


def _cell(column: str) -> str:
    text = f"coalesce({column}::VARCHAR, '')"
    return (f"CASE WHEN regexp_matches({text}, '[\",\\r\\n]')"
            f" THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END")


def _line(columns: list[str]) -> str:
    return " || ',' || ".join(_cell(c) for c in columns)


@query(f"""SELECT (p_partkey // 1000)::BIGINT AS block_no, count(*) AS n_rows,
  string_agg({_line(FACT_COLUMNS)}, chr(10) ORDER BY p_partkey) AS block
FROM part GROUP BY 1""")
def fact_blocks(spark, sf):
    """The shared context of all questions without ids, in bounded blocks."""
    return rt.fact_blocks(_parts(spark, sf), FACT_COLUMNS, F.col("p_partkey"), span=1000)


@query("""SELECT (r_regionkey // 1000)::BIGINT AS block_no, count(*) AS n_rows,
  string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) AS block
FROM region GROUP BY 1""")
def reference_blocks(spark, sf):
    """The reference table that all requests share."""
    region = read_table(spark, sf, "region")
    return rt.fact_blocks(region, ["r_regionkey", "r_name"], F.col("r_regionkey"))


@query("""SELECT page_id, b::INT AS block_no, md5(substr(html, (b * 500 + 1)::BIGINT, 500)) AS block_md5
FROM (SELECT page_id, html, unnest(range(0, (greatest(length(html), 1) - 1) // 500 + 1)) AS b FROM pages)""")
def corpus_blocks(spark, sf):
    """The corpus that all requests share, in bounded blocks."""
    blocks = rt.text_blocks(read_table(spark, sf, "pages"), ["page_id"], "html", span=500)
    return blocks.select("page_id", "block_no", F.md5("block").alias("block_md5"))


def _request_sql(ids: str, corpus: str, extra: str) -> str:
    return f"""WITH {_wanted(ids)}, c AS (
  SELECT page_id, string_agg({_line(FACT_COLUMNS)}, chr(10) ORDER BY p_partkey) AS facts
  FROM w JOIN part ON p_partkey = id GROUP BY page_id)
SELECT page_id, CASE WHEN len(ids) = 0 THEN 'ALL' ELSE 'IDS' END AS context_ref,
  concat_ws(chr(10), '## Facts',
    CASE WHEN len(ids) = 0 THEN 'see blocks: ALL'
         ELSE concat_ws(chr(10), '{','.join(FACT_COLUMNS)}', facts) END,
    '## Reference ranges', 'see blocks: RANGES', {corpus}
    'Category: ' || coalesce(regexp_extract(url, '/([a-z]{{2}})/', 1), ''), {extra}
    'Question: ' || url) AS request
FROM q LEFT JOIN c USING (page_id)"""


@query(_request_sql(_IDS, "", ""))
def request_table(spark, sf):
    return rt.build_requests(
        _questions(spark, sf), "page_id", "question", _parts(spark, sf), "p_partkey", FACT_COLUMNS,
        "RANGES", extra=[("Category", "category")])


@query(_request_sql(_WITH_EXPECTED, "'## Procedures', 'see blocks: CORPUS',", "'Generated answer: See ' || url,"))
def judge_request_table(spark, sf):
    """What the judging service is asked: the answer, the expected fact, ranges and corpus."""
    answered = _questions(spark, sf, expected=True).withColumn("answer", F.concat(F.lit("See "), "question"))
    return rt.build_requests(
        answered, "page_id", "question", _parts(spark, sf), "p_partkey", FACT_COLUMNS, "RANGES", "CORPUS",
        extra=[("Category", "category"), ("Generated answer", "answer")])


GOLDEN_SQL = f"""ranges AS ({PART_RANGES}),
ranged AS (
  SELECT p_partkey, p_name, p_type, p_size::DOUBLE AS size, 'P-' || p_partkey AS part_id,
    reference_low AS lo, reference_high AS hi,
    CASE WHEN p_size < reference_low OR p_size > reference_high THEN 'OOS' ELSE 'Pass' END AS status,
    ('0x' || substr(md5(p_partkey || '|42'), 1, 8))::BIGINT % 3 AS kind
  FROM part JOIN ranges USING (p_type)),
golden AS (
  SELECT *, CASE kind
      WHEN 0 THEN 'What was the ' || p_name || ' result of ' || part_id || '?'
      WHEN 1 THEN 'Did ' || part_id || ' pass or was it out of specification?'
      ELSE 'What is the valid range of ' || p_name || ', and is the result of ' || part_id
        || ' inside it?' END AS question,
    CASE kind WHEN 0 THEN size || ' cm' WHEN 1 THEN status
      ELSE 'Range ' || lo || '-' || hi || ' cm. The result is '
        || CASE status WHEN 'OOS' THEN 'outside (OOS)' ELSE 'inside' END || '.' END AS expected_answer,
    CASE kind WHEN 0 THEN 'value_lookup' WHEN 1 THEN 'status_reasoning'
      ELSE 'range_reasoning' END AS category
  FROM ranged)"""
_GOLDEN_COLUMNS = ["part_id", "question", "expected_answer", "category"]


@query(f"WITH {GOLDEN_SQL} SELECT {', '.join(_GOLDEN_COLUMNS)} FROM golden")
def golden_set(spark, sf):
    return golden(spark, sf).select(*_GOLDEN_COLUMNS)


@query(f"""WITH {GOLDEN_SQL} SELECT {', '.join(_GOLDEN_COLUMNS)} FROM golden
ORDER BY md5(p_partkey || '|sample'), p_partkey LIMIT 40""")
def golden_sample(spark, sf):
    """Exactly forty questions: the sampling operator."""
    return sample_exact(golden(spark, sf), "p_partkey", 40, "sample").select(*_GOLDEN_COLUMNS)


@query(f"""WITH {GOLDEN_SQL} SELECT category, count(*) AS n,
  count(*) FILTER (WHERE p_partkey % 5 <> 0) AS n_id_ok, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS n_answer_ok
FROM golden GROUP BY category""")
def golden_self_check(spark, sf):
    """Every fifth expected id and every seventh expected answer is spoilt on purpose."""
    facts = ranged_parts(spark, sf).select("part_id", "size", "reference_low", "reference_high")
    answer = F.col("expected_answer")
    spoilt = (
        F.when(answer == "OOS", "Pass").when(answer == "Pass", "OOS")
        .when(answer.contains("Range"), F.regexp_replace(answer, "Range [0-9]", "Range 77"))
        .otherwise(F.concat(F.lit("9"), answer)))
    questions = golden(spark, sf).withColumns({
        "expected_answer": F.when(F.col("p_partkey") % 7 == 0, spoilt).otherwise(answer),
        "part_id": F.when(F.col("p_partkey") % 5 == 0, F.concat("part_id", F.lit("0"))).otherwise(F.col("part_id"))})
    checked = gd.self_check(questions, facts, PART_ID, "part_id", "size")
    return checked.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("id_ok").alias("n_id_ok"),
        F.count_if("answer_ok").alias("n_answer_ok"))

"""Text checks over documents, conversations, pages and templated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.operators import golden as gd
from answergauge.operators import textchecks as tc
from answergauge.plans import inputs as src
from answergauge.plans.registry import collector
from answergauge.plans.retrieval import GOLDEN_SQL, golden
from answergauge.session import written
from answergauge.sources.readers import read_table

QUERIES, query = collector()

# Literals of the example that answers must not repeat.
EXAMPLE_LITERALS = [70.0, 100.0]


def _bot_answers(spark, sf):
    """Answers to the golden questions with the flaws the checks look for.

    The first word of the part name picks the flaw: hot stops before the value,
    cold adds facts, old gives a status instead of numbers, new repeats the
    example; every other answer is right.
    """
    name = F.substring_index("p_name", " ", 1)
    low, high = (F.col(c).cast("string") for c in ("reference_low", "reference_high"))
    answer = (
        F.when(name == "hot", "The result is")
        .when(name == "cold", F.concat(
            F.col("expected_answer"), F.lit(" It is rated "), F.col("status"),
            F.lit(", the range is "), low, F.lit("-"), high, F.lit(".")))
        .when(name == "old", F.concat(F.lit("The status is "), F.col("status"), F.lit(".")))
        .when(name == "new", F.concat(F.col("expected_answer"), F.lit(" For example 70-100 mg.")))
        .otherwise(F.col("expected_answer"))
    )
    return golden(spark, sf).withColumn("answer", answer)


_BOT_SQL = f"""{GOLDEN_SQL}, bot AS (
  SELECT *, CASE split_part(p_name, ' ', 1)
    WHEN 'hot' THEN 'The result is'
    WHEN 'cold' THEN expected_answer || ' It is rated ' || status || ', the range is ' || lo || '-' || hi || '.'
    WHEN 'old' THEN 'The status is ' || status || '.'
    WHEN 'new' THEN expected_answer || ' For example 70-100 mg.'
    ELSE expected_answer END AS answer FROM golden),
found AS (SELECT *, list_distinct(list_transform(
    regexp_extract_all(regexp_replace(answer, '([0-9A-Za-z])-', '\\1 ', 'g'), '-?[0-9]+(\\.[0-9]+)?'), lambda x: x::DOUBLE)) AS nums FROM bot)"""


@query(f"""WITH {_BOT_SQL} SELECT part_id, category, answer, list_contains(nums, size) AS value_present
FROM found""")
def value_in_answer(spark, sf):
    return tc.value_in_answer(_bot_answers(spark, sf), "answer", "size").select(
        "part_id", "category", "answer", "value_present")


@query(f"""WITH {_BOT_SQL} SELECT part_id, answer FROM found
WHERE category = 'range_reasoning' AND regexp_matches(answer, '\\b(Pass|OOS)\\b')
  AND NOT (list_contains(nums, lo) AND list_contains(nums, hi))""")
def status_for_range(spark, sf):
    return tc.status_instead_of_range(
        _bot_answers(spark, sf), "answer", "category", gd.RANGE,
        ["reference_low", "reference_high"]).select("part_id", "answer")


@query(f"""WITH {_BOT_SQL}, e AS (
  SELECT part_id, answer, len(list_filter(nums, lambda x: x IN (70, 100))) AS echoed FROM found)
SELECT * FROM e WHERE echoed > 0""")
def example_echo(spark, sf):
    return tc.example_echo(_bot_answers(spark, sf), "answer", EXAMPLE_LITERALS).select(
        "part_id", "answer", "echoed")


# The length of the example phrases, in words.
PHRASE_WORDS = 4


@query(f"""WITH phrases AS (
  SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1:{PHRASE_WORDS}], ' ') AS phrase
  FROM benchmark),
met AS (SELECT conv_id, turn, phrase FROM conversations JOIN phrases ON phrase <> '' AND contains(text, phrase)
  UNION ALL SELECT -1, doc_id, phrase FROM documents JOIN phrases ON phrase <> '' AND contains(text, phrase))
SELECT conv_id || '/' || turn AS answer_id, count(*) AS echoed, min(phrase) AS first_echo FROM met GROUP BY ALL""")
def example_echo_phrases(spark, sf):
    """Turns and documents that repeat the opening words of a benchmark item."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    phrases = read_table(spark, sf, "benchmark").select(
        F.array_join(F.slice(words, 1, PHRASE_WORDS), " ").alias("phrase"))
    turns = read_table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("answer_id"), "text")
    answers = src.documents(spark, sf).select(F.concat_ws("/", F.lit(-1), "doc_id").alias("answer_id"), "text")
    return tc.phrase_echo(
        turns.unionByName(answers), "answer_id", "text", phrases, "phrase", lambda df: written(df, "phrases"))


def _padded(spark, sf):
    allowed = {
        gd.LOOKUP: ["size"], gd.STATUS: [], gd.RANGE: ["reference_low", "reference_high", "size"]}
    return tc.unrequested_facts(
        _bot_answers(spark, sf), "answer", "category", allowed,
        status_categories=(gd.STATUS, gd.RANGE))


_PADDED_SQL = f"""{_BOT_SQL}, extra AS (
  SELECT part_id, category, len(list_filter(nums, lambda x: CASE category
      WHEN 'value_lookup' THEN x <> size WHEN 'status_reasoning' THEN true
      ELSE x <> lo AND x <> hi AND x <> size END)) AS extra_numbers,
    category = 'value_lookup' AND regexp_matches(answer, '\\b(Pass|OOS)\\b') AS extra_status
  FROM found),
padded AS (SELECT *, extra_numbers > 0 OR extra_status AS padded FROM extra)"""


@query(f"WITH {_PADDED_SQL} SELECT part_id, category, extra_numbers, extra_status, padded FROM padded")
def unrequested_facts(spark, sf):
    return _padded(spark, sf).select("part_id", "category", "extra_numbers", "extra_status", "padded")


@query(f"""WITH {_PADDED_SQL} SELECT category, count(*) AS n, count(*) FILTER (WHERE padded) AS n_padded,
  round(avg(padded::INT), 6) AS padded_rate FROM padded GROUP BY category""")
def padding_rate(spark, sf):
    return tc.padding_rate(_padded(spark, sf), ["category"]).withColumn(
        "padded_rate", F.round("padded_rate", 6))


def _leakage(spark, sf):
    docs = src.documents(spark, sf).select("doc_id", F.col("source").alias("run_id"), "lang", "text")
    return tc.language_leakage(docs, "text").drop("text")


_OFF = "length(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g'))"
_LEAK_SQL = f"""leak AS (SELECT doc_id, source AS run_id, lang, {_OFF} AS off_script_chars,
  {src.sql_share('text')} AS off_script_share FROM documents)"""


@query(f"""WITH {_LEAK_SQL} SELECT doc_id, run_id, lang, off_script_chars,
  round(off_script_share, 6) AS off_script_share FROM leak""")
def language_leakage(spark, sf):
    return _leakage(spark, sf).withColumn("off_script_share", F.round("off_script_share", 6))


@query(f"""WITH {_LEAK_SQL} SELECT run_id, lang, count(*) AS n, round(avg(off_script_share), 6) AS mean_share,
  round(max(off_script_share), 6) AS max_share,
  count(*) FILTER (WHERE off_script_share > CASE lang WHEN 'en' THEN 0.001 ELSE 0.08 END) AS n_over_limit
FROM leak GROUP BY ALL""")
def leakage_by_run(spark, sf):
    limit = F.when(F.col("lang") == "en", 0.001).otherwise(0.08)
    return tc.leakage_by(_leakage(spark, sf), ["run_id", "lang"], limit).withColumns(
        {c: F.round(c, 6) for c in ("mean_share", "max_share")})


def _turn_lengths(spark, sf):
    return tc.length_bands(read_table(spark, sf, "conversations"), "text")


_LENGTH_SQL = f"""s AS (SELECT conv_id, turn, role, {src.sql_sentences('text')} AS sentences FROM conversations)"""


@query(f"""WITH {_LENGTH_SQL} SELECT conv_id, turn, role, sentences,
  CASE WHEN sentences <= 3 THEN 'good' WHEN sentences <= 5 THEN 'ok' ELSE 'bad' END AS length_verdict FROM s""")
def length_bands(spark, sf):
    return _turn_lengths(spark, sf).select("conv_id", "turn", "role", "sentences", "length_verdict")


@query(f"""WITH {_LENGTH_SQL} SELECT role, count(*) AS n, count(*) FILTER (WHERE sentences = 1) AS n_single,
  round(avg((sentences = 1)::INT), 6) AS single_share FROM s GROUP BY role""")
def single_sentence_share(spark, sf):
    return tc.single_sentence_share(_turn_lengths(spark, sf), ["role"]).withColumn(
        "single_share", F.round("single_share", 6))


_FIRST3 = src.sql_strip(
    f"array_to_string(regexp_extract_all({src.sql_clean('text')}, '[^.!?]+[.!?]*')[1:3], '')")


@query(f"SELECT conv_id, turn, {_FIRST3} AS cleaned FROM conversations")
def clean_text(spark, sf):
    """The length rule of an answer: its first three sentences, off-script words dropped."""
    return tc.clean_answers(read_table(spark, sf, "conversations"), "text", max_sentences=3).select(
        "conv_id", "turn", "cleaned")


@query("""WITH s AS (
  SELECT page_id, generate_subscripts(parts, 1) - 1 AS section_no, unnest(parts) AS section
  FROM (SELECT page_id, string_split(html, '<p>') AS parts FROM pages)),
c AS (
  SELECT page_id, section_no, generate_subscripts(parts, 1) - 1 AS clause_no, unnest(parts) AS clause
  FROM (SELECT page_id, section_no, string_split(section, '<br>') AS parts FROM s))
SELECT page_id, section_no, clause_no, md5(clause) AS clause_md5, length(clause) AS clause_chars FROM c""")
def corpus_sections(spark, sf):
    clauses = tc.sections(read_table(spark, sf, "pages"), ["page_id"], "html", "<p>", "<br>")
    return clauses.select(
        "page_id", "section_no", "clause_no", F.md5("clause").alias("clause_md5"),
        F.length("clause").alias("clause_chars"))

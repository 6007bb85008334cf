import pytest
from pyspark.sql import functions as F

from answergauge.operators import golden as gd
from answergauge.operators import ranges as rg
from answergauge.operators import retrieve as rt

PATTERN = r"S-\d{5}"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([
        ("S-10001", "Glucose", 82.5, "mg/dL", 70.0, 100.0),
        ("S-10002", "Sodium, total", 150.0, "mmol/L", 135.0, 145.0),
        ("S-10003", "Glucose", 70.0, "mg/dL", 70.0, 100.0),
    ], "sample_id string, test_name string, result_value double, unit string, "
       "reference_low double, reference_high double")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([
        (1, "Result of S-10001 and again S-10001?", None),
        (2, "Which samples failed?", ""),
        (3, "Is S-100023 fine?", "S-10003"),
        (4, "Is S-99999 fine?", None),
    ], "qid int, question string, expected string")


def test_ids(spark, questions):
    got = {r.qid: (r.ids, r.context_ref) for r in rt.with_ids(questions, "question", PATTERN).collect()}
    assert got == {1: (["S-10001"], "IDS"), 2: ([], "ALL"), 3: (["S-10002"], "IDS"), 4: (["S-99999"], "IDS")}
    more = {r.qid: r.ids for r in rt.with_ids(questions, "question", PATTERN, "expected").collect()}
    assert more[3] == ["S-10002", "S-10003"] and more[2] == []


def test_retrieve_keeps_fall_back_as_one_row(questions, facts):
    asked = rt.with_ids(questions, "question", PATTERN)
    rows = rt.retrieve(asked, "qid", facts, "sample_id").collect()
    assert sorted((r.qid, r.context_ref, r.sample_id) for r in rows) == [
        (1, "IDS", "S-10001"), (2, "ALL", None), (3, "IDS", "S-10002")]


def test_requests(spark, questions, facts):
    rows = {r.qid: r.request for r in rt.build_requests(
        rt.with_ids(questions, "question", PATTERN, "expected"), "qid", "question", facts, "sample_id",
        ["sample_id", "test_name", "result_value"], "RANGES", "CORPUS", extra=[("Expected", "expected")]).collect()}
    assert len(rows) == 4
    assert rows[3] == (
        "## Facts\nsample_id,test_name,result_value\nS-10002,\"Sodium, total\",150.0\nS-10003,Glucose,70.0\n"
        "## Reference ranges\nsee blocks: RANGES\n## Procedures\nsee blocks: CORPUS\n"
        "Expected: S-10003\nQuestion: Is S-100023 fine?")
    assert "see blocks: ALL" in rows[2]
    assert rows[4].startswith("## Facts\nsample_id,test_name,result_value\n## Reference")


def test_corpus_blocks_are_whole(spark):
    rules = spark.createDataFrame([("a", "1. Rule. " * 50), ("b", "x"), ("c", ""), ("d", None)], "path string, text string")
    parts = {}
    for r in rt.text_blocks(rules, ["path"], "text", span=7).orderBy("path", "block_no").collect():
        assert len(r.block) <= 7
        parts[r.path] = parts.get(r.path, "") + r.block
    assert parts == {"a": "1. Rule. " * 50, "b": "x", "c": ""}


def test_blocks_cover_all_facts(spark):
    facts = spark.range(25).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    blocks = rt.fact_blocks(facts, ["id", "name"], F.col("id"), span=10).orderBy("block_no").collect()
    assert [b.n_rows for b in blocks] == [10, 10, 5]
    assert "\n".join(b.block for b in blocks) == "\n".join(f"{i},n{i}" for i in range(25))
    number = F.regexp_extract("name", "[0-9]+", 0).cast("bigint")
    assert rt.fact_blocks(facts, ["name"], number, span=20).count() == 2


def test_status_rate_and_audit(spark, facts):
    dim = facts.select("test_name", "reference_low", "reference_high").distinct()
    plain = facts.select("sample_id", "test_name", "result_value")
    ranged = rg.with_range_status(plain, dim, "test_name", "result_value")
    status = {r.sample_id: (r.status, r.in_range) for r in ranged.collect()}
    assert status == {"S-10001": ("Pass", True), "S-10002": ("OOS", False), "S-10003": ("Pass", True)}
    stored = ranged.withColumn("stored", F.when(F.col("sample_id") != "S-10003", "Pass"))
    audit = rg.status_audit(stored, "stored").collect()
    assert sorted(r.sample_id for r in audit) == ["S-10002", "S-10003"]
    rate = {r.test_name: (r.n, r.n_oos, r.oos_rate) for r in rg.out_of_range_rate(ranged, ["test_name"]).collect()}
    lost = rg.with_range_status(plain, dim.where("test_name = 'Glucose'"), "test_name", "result_value")
    assert {r.test_name: (r.n, r.n_no_range, r.oos_rate) for r in rg.out_of_range_rate(lost, ["test_name"]).collect()} == {
        "Glucose": (2, 0, 0.0), "Sodium, total": (1, 1, None)}
    assert rate == {"Glucose": (2, 0, 0.0), "Sodium, total": (1, 1, 1.0)}


def test_golden_set_checks_itself_and_finds_a_wrong_answer(spark, facts):
    many = spark.range(60).select(
        F.format_string("S-%05d", F.col("id") + 10000).alias("sample_id"),
        F.lit("Glucose").alias("test_name"), (F.col("id") + 50.5).alias("result_value"),
        F.lit("mg/dL").alias("unit"), F.lit(70.0).alias("reference_low"), F.lit(100.0).alias("reference_high"))
    ranged = many.withColumns({
        "status": F.expr("if(result_value < 70 or result_value > 100, 'OOS', 'Pass')"),
        "in_range": F.expr("result_value between 70 and 100")})
    questions = gd.golden_set(ranged, "sample_id", "sample_id", "test_name", "result_value", "unit", "seed")
    facts_side = many.select("sample_id", "result_value", "reference_low", "reference_high")
    checked = gd.self_check(questions, facts_side, PATTERN, "sample_id", "result_value").collect()
    assert len(checked) == 60 and all(r.id_ok and r.answer_ok for r in checked)
    assert {r.category for r in checked} == {gd.LOOKUP, gd.STATUS, gd.RANGE}
    moved = facts_side.withColumn("result_value", F.lit(500.0))
    wrong = gd.self_check(questions, moved, PATTERN, "sample_id", "result_value").collect()
    assert not any(r.answer_ok for r in wrong if r.category == gd.LOOKUP)

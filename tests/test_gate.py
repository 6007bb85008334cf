import pytest
from pyspark.sql import functions as F

from answergauge.functions.verdicts import CRITERIA
from answergauge.operators import gate as gt
from answergauge.operators.scorer import bulk_score

VERDICTS = {c: c for c in CRITERIA}
CELLS = [f"judge_{c}_verdict" for c in (*CRITERIA, "latency")] + ["judge_final_score"]


@pytest.fixture(scope="module")
def sheet(spark):
    schema = "id int, " + ", ".join(f"{c} string" for c in CRITERIA) + ", latency double, broken boolean"
    return spark.createDataFrame([
        (1, "good", "good", "good", "good", "good", 100.0, False),
        (2, "good", "good", "good", "good", "ok", 100.0, False),
        (3, "bad", "good", "good", "good", "good", 9000.0, False),
        (4, "good", "good", "good", "good", "good", 100.0, True),
        (5, "bad", "good", "good", "good", "good", float("nan"), None),
    ], schema)


def test_error_stays_in_its_row(sheet):
    got = {r.id: r for r in gt.gate(sheet, VERDICTS, "latency", failed=F.col("broken")).collect()}
    assert [got[i].judge_final_score for i in (1, 2, 3, 4, 5)] == ["pass", "fail", "fail", "ERROR", "fail"]
    assert all(got[4][c] == "ERROR" for c in CELLS)
    assert got[5].judge_latency_verdict == "bad"
    assert (got[3].judge_good_count, got[3].judge_bad_count) == (4, 2)


def test_distribution_and_errors(sheet):
    judged = gt.gate(sheet.withColumn("run", F.lit("a")), VERDICTS, "latency", failed=F.col("broken"))
    rows = gt.final_score_distribution(judged, "judge_final_score").collect()
    assert [(r.judge_final_score, r.n) for r in rows] == [("fail", 3), ("ERROR", 1), ("pass", 1)]
    assert [(r.run, r.errors) for r in gt.error_counts(judged, "run", "judge_tone_verdict").collect()] == [("a", 1)]
    clean = judged.where("id = 1")
    assert gt.error_counts(clean, "run", "judge_tone_verdict").count() == 0


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, None)], "id int, v string")
    fill = {r.id: r.v for r in gt.upsert(old, new, ["id"], ["v"]).collect()}
    assert fill == {1: "x", 2: None}
    replaced = {r.id: r.v for r in gt.upsert(old, new.fillna("z"), ["id"], ["v"], mode="replace").collect()}
    assert replaced == {1: None, 2: "z"}
    added = gt.with_judge_columns(old, ["v", "w"]).collect()
    assert [(r.v, r.w) for r in added] == [("x", None), ("y", None)]
    with pytest.raises(ValueError):
        gt.with_judge_columns(old, ["v"], "other")


def test_retry_touches_errors_only_and_is_idempotent(sheet):
    judged = gt.gate(sheet, VERDICTS, "latency", failed=F.col("broken")).select("id", *CELLS)
    # new replies exist for an errored row and for a clean one
    again = gt.gate(sheet.where("id in (2, 4)").withColumn("fluency", F.lit("ok")), VERDICTS, "latency")
    once = gt.retry_errors(judged, again, ["id"], CELLS, "judge_fluency_verdict")
    twice = gt.retry_errors(once, again, ["id"], CELLS, "judge_fluency_verdict")
    before = {r.id: r for r in judged.collect()}
    after = {r.id: r for r in once.collect()}
    assert after[4].judge_final_score == "pass" and after[4].judge_fluency_verdict == "ok"
    assert all(after[i] == before[i] for i in (1, 2, 3, 5))
    assert {r.id: r for r in twice.collect()} == after


def test_subset_and_escalation(spark, sheet):
    rated = sheet.select("id", F.when(F.col("id") < 3, "good").when(F.col("id") == 3, "").alias("Fluency"))
    scored = gt.gate(sheet, VERDICTS, "latency")
    filled = {r.id: r.judge_final_score for r in
              gt.judge_subset(rated, scored, ["id"], CELLS, "Fluency").collect()}
    assert filled == {1: "pass", 2: "fail", 3: None, 4: None, 5: None}
    assert [r.id for r in gt.rated(rated, "Fluency").collect()] == [1, 2]
    missing = spark.createDataFrame([(1, "good"), (2, "ok"), (3, None)], "id int, g string")
    assert [r.id for r in gt.escalation(missing, "g").collect()] == [2, 3]


def test_bulk_score_isolates_failures(spark):
    def rule(text):
        if text == "boom":
            raise ValueError("no reply")
        return "good" if len(text) < 4 else "bad"

    df = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "abcdef")], "id int, t string")
    rows = {r.id: r for r in bulk_score(df, ["id"], "t", rule, parallelism=2).collect()}
    assert [(rows[i].verdict, rows[i].error) for i in (1, 2, 3)] == [
        ("good", None), ("ERROR", "no reply"), ("bad", None)]
    assert all(r.elapsed_ms >= 0 for r in rows.values())
    assert bulk_score(df.limit(0), ["id"], "t", rule).count() == 0

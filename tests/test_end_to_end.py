"""The three jobs of an evaluation, from files to the agreement table, on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from answergauge.functions.verdicts import CRITERIA
from answergauge.operators import agreement as ag
from answergauge.operators import gate as gt
from answergauge.operators import replies as rp
from answergauge.operators import retrieve as rt
from answergauge.operators.numbering import number_rows, source_order
from answergauge.operators.runs import pass_rate
from answergauge.sources import readers, writers

SAMPLES = """sample_id,test_name,result_value,unit,reference_low,reference_high,status,technician,instrument,collected_at,batch_id
S-20001,Glucose,82.5,mg/dL,70,100,Pass,A. B,X-1,2026-03-01 08:00,B-1
S-20002,Sodium,150.25,mmol/L,135,145,OOS,"C, D",X-2,2026-03-01 09:00,B-1
S-20003,Glucose,70,mg/dL,70,100,Pass,A. B,X-1,2026-03-02 10:30,B-2
"""
RANGES = "test_name,unit,reference_low,reference_high\nGlucose,mg/dL,70,100\nSodium,mmol/L,135,145\n"
QUESTIONS = [
    ("What is the result of S-20001?", "82.5 mg/dL", "S-20001", "value_lookup"),
    ("Did S-20002 pass?", "OOS", "S-20002", "status_reasoning"),
    ("Is S-20003 inside its range?", "Range 70.0-100.0", "S-20003", "range_reasoning"),
    ("Which samples failed?", "S-20002", "", "status_reasoning"),
]
HUMAN = [("goood", "good"), ("good", "ok"), ("bda", "good"), (None, None)]  # fluency, tone
RUN = "run-1"


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lab")
    (folder / "samples.csv").write_text(SAMPLES)
    (folder / "ranges.csv").write_text(RANGES)
    (folder / "rules.md").write_text("# Rules\n\n## Status\n1. Inside the range is Pass.\n")
    (folder / "questions.jsonl").write_text("".join(
        json.dumps(dict(zip(("question", "expected_answer", "expected_sample_id", "category"), q))) + "\n"
        for q in QUESTIONS))
    ordered = source_order(readers.read_jsonl(spark, str(folder / "questions.jsonl")))
    return {
        "facts": readers.read_csv(spark, str(folder / "samples.csv"), readers.SAMPLES, readers.LAB_TIME),
        "ranges": readers.read_csv(spark, str(folder / "ranges.csv"), readers.RANGES),
        "rules": readers.read_documents(spark, str(folder / "rules.md")).select("text"),
        "questions": number_rows(ordered.withColumn("run_id", F.lit(RUN)), "run_id", "position").drop("position"),
    }


def test_requests(lab):
    asked = rt.with_ids(lab["questions"], "question", r"S-\d{5}", "expected_sample_id")
    columns = ["sample_id", "test_name", "result_value", "technician"]
    rows = {r.row_no: r for r in rt.build_requests(
        asked, "row_no", "question", lab["facts"], "sample_id", columns, "RANGES", "CORPUS",
        extra=[("Category", "category")]).collect()}
    assert [rows[i].context_ref for i in (1, 2, 3, 4)] == ["IDS", "IDS", "IDS", "ALL"]
    assert 'S-20002,Sodium,150.25,"C, D"' in rows[2].request and "S-20001" not in rows[2].request
    assert rows[4].request.endswith("Category: status_reasoning\nQuestion: Which samples failed?")
    assert all("see blocks: CORPUS" in r.request for r in rows.values())
    shared = rt.text_blocks(lab["rules"], [], "text").collect()
    assert [r.block for r in shared] == ["# Rules\n\n## Status\n1. Inside the range is Pass.\n"]


def _judge_reply(**verdicts):
    cells = {c: {"explanation": f"{c} checked", "verdict": "good"} for c in CRITERIA}
    for c, v in verdicts.items():
        cells[c]["verdict"] = v
    return json.dumps(cells)


def test_record_judge_retry_and_compare(spark, lab, tmp_path):
    folder = str(tmp_path / "sheets")
    # 1. replies become the run sheet, version 1
    replies = spark.createDataFrame([
        (1, [("text", "82.5 mg/dL\n")], 1200.0, (500, 9)), (2, [("text", "It is OOS.")], 2600.0, (510, 6)),
        (3, [("tool_use", "x"), ("text", "Range 70.0-100.0, inside.")], 900.0, (505, 12)),
        (4, [("text", "S-20002")], 7000.0, (9000, 5)),
    ], "row_no bigint, content array<struct<type: string, text: string>>, ms double, "
       "usage struct<input_tokens: bigint, output_tokens: bigint>")
    keep = ["run_id", "row_no", "question", "category", "expected_answer", "expected_sample_id"]
    records = rp.run_records(
        lab["questions"].join(replies, "row_no"), keep, "content", "ms", "usage", ["Fluency", "Tone"])
    writers.write_run_sheets(records, folder, "1")

    # 2. a person rates three rows: version 2
    human = spark.createDataFrame(
        [(RUN, i + 1, f, t) for i, (f, t) in enumerate(HUMAN) if f], "run_id string, row_no bigint, Fluency string, Tone string")
    sheet = readers.read_run_sheets(spark, folder, version="1")
    writers.write_run_sheets(gt.upsert(sheet, human, ["run_id", "row_no"], ["Fluency", "Tone"]), folder, "2")

    # 3. the judge answers, once with nonsense; only rated rows are filled in: version 3
    def judged(rows):
        raw = spark.createDataFrame(rows, "row_no bigint, reply string")
        return rp.gate_replies(
            readers.read_run_sheets(spark, folder, version="2").join(raw, "row_no"), "reply", "latency_ms")

    cells = [f"judge_{c}_verdict" for c in (*CRITERIA, "latency")] + ["judge_final_score"]
    first = judged([(1, _judge_reply()), (2, "no verdict today"), (3, "```json\n" + _judge_reply(tone="ok") + "\n```"),
                    (4, _judge_reply())])
    sheet = readers.read_run_sheets(spark, folder, version="2")
    writers.write_run_sheets(
        gt.judge_subset(sheet, first, ["run_id", "row_no"], cells, "Fluency"), folder, "3")
    third = readers.read_run_sheets(spark, folder, version="3")
    scores = {r.row_no: r.judge_final_score for r in third.collect()}
    assert scores == {1: "pass", 2: "ERROR", 3: "pass", 4: None}
    assert [(r.run_id, r.errors) for r in gt.error_counts(third, "run_id", "judge_fluency_verdict").collect()] == [(RUN, 1)]

    # 4. the retry repairs the errored row alone: version 4
    again = judged([(2, _judge_reply(grounding="bad")), (3, _judge_reply(tone="bad"))])
    writers.write_run_sheets(
        gt.retry_errors(third, again, ["run_id", "row_no"], cells, "judge_fluency_verdict"), folder, "4")
    final = readers.read_run_sheets(spark, folder)
    rows = {r.row_no: r for r in final.collect()}
    assert rows[2].judge_final_score == "fail" and rows[2].judge_latency_verdict == "ok"
    assert rows[3].judge_tone_verdict == "ok"
    assert rows[1].Fluency == "goood"  # the sheet keeps the slip

    # 5. raters and runs
    pairs = ag.pair_columns(gt.rated(final, "Fluency"), ["run_id", "row_no"], {
        "fluency": ("Fluency", "judge_fluency_verdict"), "tone": ("Tone", "judge_tone_verdict")})
    rates = {r.criterion: r for r in ag.agreement(pairs, ["criterion"]).collect()}
    assert (rates["fluency"].n, rates["fluency"].disagreements) == (3, 1)
    assert rates["fluency"].bias == pytest.approx(2 / 3)
    assert (rates["tone"].disagreements, rates["tone"].bias) == (2, pytest.approx(0.0))
    rate = pass_rate(final.where("judge_final_score is not null"), ["run_id"], "judge_final_score").first()
    assert (rate.n, rate.n_pass) == (3, 2)

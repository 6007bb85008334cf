import json

from answergauge.functions.verdicts import CRITERIA
from answergauge.operators import replies as rp


def test_reply_text_and_record(spark):
    df = spark.createDataFrame(
        [("q", [("text", "\n Hello "), ("tool_use", "ignored"), ("text", "world. \n")], 12.25, (7, 3))],
        "question string, content array<struct<type: string, text: string>>, ms double, "
        "usage struct<input_tokens: int, output_tokens: int>")
    row = rp.run_records(df, ["question"], "content", "ms", "usage", ["tone", "final_score"]).first()
    assert row.generated_description == "Hello world."
    assert (row.latency_ms, row.input_tokens, row.output_tokens) == (12.2, 7, 3)
    assert row.tone is None and row.final_score is None


ANSWERS = {
    '{"answer": "hi", "confidence": 0.9}': (None, "hi", 0.9),
    '```json\n{"answer": "hi", "confidence": 1}\n```': (None, "hi", 1.0),
    '```\n{"answer": "hi", "confidence": "0.5", "more": [1]}\n``` bye': (None, "hi", 0.5),
    '{"answer": "hi", "confidence": 1.5}': ("confidence_out_of_range", None, None),
    '{"answer": "hi"': ("invalid_json", None, None),
    "no json": ("invalid_json", None, None),
    '["answer"]': ("not_an_object", None, None),
    '{"confidence": 1}': ("missing_answer", None, None),
    '{"answer": "hi"}': ("missing_confidence", None, None),
    '{"answer": 5, "confidence": 1}': ("answer_not_text", None, None),
    '{"answer": "no", "answer": "hi", "confidence": 1}': (None, "hi", 1.0),
    '{"answer": null, "confidence": 1}': ("answer_not_text", None, None),
    '{"answer": "hi", "confidence": "high"}': ("confidence_not_number", None, None),
    '{"answer": "hi", "confidence": [1]}': ("confidence_not_number", None, None),
}


def test_answer_validation(spark):
    df = spark.createDataFrame([(k,) for k in ANSWERS], "raw string")
    got = {r.raw: (r.reason, r.answer, r.confidence) for r in
           rp.validate_answers(df, "raw", require_unit_range=True).collect()}
    assert got == ANSWERS
    lenient = rp.validate_answers(df, "raw")
    assert lenient.where("raw like '%1.5%'").first().confidence == 1.5
    counts = {r.outcome: r.n for r in rp.reason_counts(lenient).collect()}
    assert counts["valid"] == 5 and sum(counts.values()) == len(ANSWERS)


def _verdicts(**changes):
    reply = {c: {"explanation": "e", "verdict": "good"} for c in CRITERIA}
    reply.update(changes)
    return json.dumps({c: v for c, v in reply.items() if v is not None})


def test_verdict_validation(spark):
    replies = {
        _verdicts(): None,
        "```json\n" + _verdicts(tone={"explanation": "x", "verdict": "bad"}) + "\n```": None,
        _verdicts(tone=None): "missing_criterion",
        _verdicts(tone={"verdict": "good"}): "missing_criterion",
        _verdicts(length={"explanation": "x", "verdict": "goood"}): "verdict_off_scale",
        "sorry": "unreadable",
    }
    df = spark.createDataFrame(list(enumerate(replies)), "id int, raw string")
    judged = rp.validate_verdicts(df, "raw")
    rows = {r.id: r for r in judged.collect()}
    for i, reason in enumerate(replies.values()):
        assert rows[i].reason == reason
        if reason:
            assert {rows[i][f"{c}_verdict"] for c in CRITERIA} == {"ERROR"}
            assert rows[i].tone_explanation == reason
    assert rows[1].tone_verdict == "bad" and rows[1].tone_explanation == "x"
    melted = rp.melt_verdicts(judged, ["id"], "judge")
    assert melted.count() == 5 * len(replies)
    assert melted.columns == ["id", "rater", "criterion", "verdict", "explanation"]


def test_citations(spark):
    documents = spark.createDataFrame([(1, "Alpha beta. Gamma delta."), (2, "Other text.")], "doc int, text string")
    replies = {
        (1, "Yes. Reference: Gamma delta."): "supported",
        (1, "Reference:  beta. Gamma \n"): "supported",
        (1, "Reference: gamma delta."): "unsupported",
        (2, "Reference: Gamma delta."): "unsupported",
        (3, "Reference: Gamma delta."): "unsupported",
        (1, "I can't find that in the document."): "refused",
        (1, "Just an answer."): "no_citation",
        (1, "Reference: "): "no_citation",
    }
    df = spark.createDataFrame(list(replies), "doc int, reply string")
    got = {(r.doc, r.reply): r.outcome for r in
           rp.check_citations(df, documents, "doc", "reply", "text").collect()}
    assert got == replies

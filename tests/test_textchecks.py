import pytest
from pyspark.sql import functions as F

from answergauge.operators import textchecks as tc


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([
        (1, "lookup", "The result is 82.16 mg/dL.", 82.16, 70.0, 100.0),
        (2, "lookup", "82.160, range 70-100, Pass.", 82.16, 70.0, 100.0),
        (3, "range", "It is Pass.", 82.16, 70.0, 100.0),
        (4, "range", "Range 70.0-100.0. OOS", 120.0, 70.0, 100.0),
        (5, "status", "Pass", 82.16, 70.0, 100.0),
        (6, "status", "Pass, 82.16", 82.16, 70.0, 100.0),
        (7, "lookup", "The result is", 82.16, 70.0, 100.0),
        (8, "lookup", "Passing 82.16", 82.16, 70.0, 100.0),
    ], "id int, category string, answer string, value double, low double, high double")


def test_value_present(answers):
    got = {r.id: r.value_present for r in tc.value_in_answer(answers, "answer", "value").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: True}


def test_status_where_numbers_belong(answers):
    rows = tc.status_instead_of_range(answers, "answer", "category", "range", ["low", "high"])
    assert [r.id for r in rows.collect()] == [3]


def test_example_echo(answers):
    got = {r.id: r.echoed for r in tc.example_echo(answers, "answer", [70, 100, 5.5]).collect()}
    assert got == {2: 2, 4: 2}


def test_unrequested_facts(answers):
    allowed = {"lookup": ["value"], "status": [], "range": ["value", "low", "high"]}
    rows = tc.unrequested_facts(
        answers, "answer", "category", allowed, status_categories=("status", "range"))
    got = {r.id: (r.extra_numbers, r.extra_status, r.padded) for r in rows.collect()}
    assert got[1] == (0, False, False) and got[2] == (2, True, True)
    assert got[4] == (0, False, False) and got[5] == (0, False, False)
    assert got[6] == (1, False, True) and got[8] == (0, False, False)
    rate = {r.category: r.padded_rate for r in tc.padding_rate(rows, ["category"]).collect()}
    assert rate == {"lookup": 0.25, "range": 0.0, "status": 0.5}


def test_leakage(spark):
    df = spark.createDataFrame([("r", "abc"), ("r", "abé"), ("r", "")], "run string, t string")
    leaked = tc.language_leakage(df, "t")
    row = tc.leakage_by(leaked, ["run"], F.lit(0.3)).first()
    assert (row.n, row.n_over_limit, round(row.mean_share, 6)) == (3, 1, round(1 / 6, 6))


def test_lengths(spark):
    df = spark.createDataFrame([("a", "One."), ("a", "One. Two. 3. 4!"), ("b", "1. 2. 3. 4. 5. 6.")], "c string, t string")
    banded = tc.length_bands(df, "t")
    assert [r.length_verdict for r in banded.collect()] == ["good", "ok", "bad"]
    share = {r.c: r.single_share for r in tc.single_sentence_share(banded, ["c"]).collect()}
    assert share == {"a": 0.5, "b": 0.0}


def test_cleaning_keeps_everything_unless_asked(spark):
    df = spark.createDataFrame([("A b. C dé. E. F. G.",)], "t string")
    assert tc.clean_answers(df, "t").first().cleaned == "A b. C E. F. G."
    assert tc.clean_answers(df, "t", 2).first().cleaned == "A b. C E."


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n## One\n1. a\n2. b\n## Two\n1. c")], "id int, t string")
    rows = tc.sections(df, ["id"], "t", "\n## ", r"\n(?=\d+\.)").collect()
    assert [(r.section_no, r.clause_no, r.clause) for r in rows] == [
        (0, 0, "intro"), (1, 0, "One"), (1, 1, "1. a"), (1, 2, "2. b"), (2, 0, "Two"), (2, 1, "1. c")]

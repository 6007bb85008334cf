import itertools
import random

from pyspark.sql import functions as F

from answergauge.functions import bands, rounding, text, verdicts


def test_latency_band_boundaries(one):
    rows = [(2500.0,), (2500.1,), (6000.0,), (6000.1,), (float("nan"),), (None,)]
    assert one(bands.latency_band(F.col("v")), rows, "v double") == [
        "good", "ok", "ok", "bad", "bad", "bad"]


def test_length_band(one):
    assert one(bands.length_band(F.col("n")), [(1,), (3,), (4,), (5,), (6,)], "n int") == [
        "good", "good", "ok", "ok", "bad"]


def test_range_is_inclusive(one):
    rows = [(70.0,), (100.0,), (69.99,), (100.01,), (None,)]
    lo, hi = F.lit(70), F.lit(100)
    assert one(bands.range_status(F.col("v"), lo, hi), rows, "v double") == [
        "Pass", "Pass", "OOS", "OOS", "Pass"]
    assert one(bands.in_range(F.col("v"), lo, hi), rows, "v double") == [
        True, True, False, False, None]


def test_gate_truth_table(spark):
    criteria = (*verdicts.CRITERIA, "latency")
    rows = list(itertools.product(verdicts.VERDICTS, repeat=6))
    df = spark.createDataFrame(rows, list(criteria))
    score = bands.final_score({c: F.col(c) for c in criteria})
    got = {tuple(r[:6]): r[6] for r in df.select(*criteria, score).collect()}
    assert len(got) == 729
    for row in rows:
        grounded = row[criteria.index("grounding")] == "good"
        expected = grounded and row.count("good") >= 4 and row.count("bad") <= 1
        assert got[row] == ("pass" if expected else "fail"), row


def test_gate_error_and_missing_cells(one):
    names = [*verdicts.CRITERIA, "latency"]
    score = bands.final_score({c: F.col(c) for c in names})
    rows = [["ERROR"] * 6, ["good"] * 4 + [None, "good"], [None] + ["good"] * 5]
    schema = ", ".join(f"{c} string" for c in names)
    assert one(score, rows, schema) == ["ERROR", "fail", "pass"]


def test_gate_parameters(one):
    score = bands.final_score({"a": F.col("a"), "b": F.col("b")}, veto="b", min_good=1, max_bad=0)
    assert one(score, [("ok", "good"), ("bad", "good"), ("good", "ok")], "a string, b string") == [
        "pass", "fail", "fail"]


def test_repair_and_ordinal(one):
    rows = [("goood",), ("bda",), ("ok",), ("ERROR",), ("strange",), (None,)]
    assert one(verdicts.repair(F.col("v")), rows, "v string") == [
        "good", "bad", "ok", "ERROR", "strange", None]
    assert one(verdicts.ordinal(verdicts.repair(F.col("v"))), rows, "v string") == [
        2, 0, 1, None, None, None]
    assert one(verdicts.in_domain(F.col("v")), rows, "v string") == [
        False, False, True, False, False, False]
    assert one(verdicts.blank_to_null(F.col("v")), [("",), ("x",), (None,)], "v string") == [
        None, "x", None]


def test_strip_all_white_space(one):
    rows = [("\n\t a b   \n",), ("",), ("　",), (None,)]
    assert one(text.strip(F.col("t")), rows, "t string") == ["a b", "", "", None]
    assert [t[0].strip() for t in rows[:3]] == ["a b", "", ""]


def test_strip_fence(one):
    rows = [('```json\n{"a": 1}\n```',), ('```\n{"a": 1}\n```\nDone.',), ('  {"a": 1}\n',),
            ('```json {"a": 1}\n',), ("```",), ("``````x",), ("``` a ``` b ``` c",)]
    assert one(text.strip_fence(F.col("t")), rows, "t string") == ['{"a": 1}'] * 4 + ["", "", "a"]


def test_csv_cells(one):
    rows = [("a,b",), ('say "x"',), ("two\nlines",), ("plain",), ("",), (None,)]
    assert one(text.csv_cell(F.col("t")), rows, "t string") == [
        '"a,b"', '"say ""x"""', '"two\nlines"', "plain", "", ""]


def test_numbers_compare_as_numbers(one):
    rows = [("range 70-100",), ("is 70.0 mg",), ("about 700",), ("",)]
    assert one(text.mentions_number(F.col("t"), F.lit(70)), rows, "t string") == [
        True, True, False, False]
    assert one(text.numbers(F.col("t")), [("1 and 1.0 and 2.5",)], "t string") == [[1.0, 2.5]]


def test_sentences_and_script(one):
    rows = [("One. Two?! Three...",), ("none",), ("",)]
    assert one(text.sentence_count(F.col("t")), rows, "t string") == [3, 0, 0]
    mixed = [("abc",), ("abאב",), ("",), ("א",)]
    assert one(text.off_script_share(F.col("t")), mixed, "t string") == [0.0, 0.5, None, 1.0]
    hebrew = r"[\x{0590}-\x{05FF}]+"
    assert one(text.off_script_share(F.col("t"), hebrew), mixed, "t string") == [1.0, 0.5, None, 0.0]


def test_clean_up(one):
    rows = [("keep déjà this. é x\nnext wé. Third. Fourth.",), ("plain  text.",)]
    assert one(text.drop_off_script_words(F.col("t")), rows, "t string") == [
        "keep this. x\nnext Third. Fourth.", "plain text."]
    assert one(text.first_sentences(F.col("t"), 2), [("A. B! C?",), ("no end",)], "t string") == [
        "A. B!", "no end"]


def test_report_formats(one):
    assert one(text.percent(F.col("v")), [(0.576923,), (0.884615,)], "v double") == ["57.7%", "88.5%"]
    assert one(text.signed(F.col("v")), [(0.5962,), (-0.0385,)], "v double") == ["+0.60", "-0.04"]
    assert one(text.occurrences(F.col("t"), "ab"), [("ababcab",), ("",)], "t string") == [3, 0]


def test_rounding_follows_the_binary_value(one):
    rng = random.Random(1)
    values = [k / 20 for k in range(-400, 400)] + [k / 200 for k in range(-2000, 2000)]
    values += [rng.uniform(-1e5, 1e5) for _ in range(2000)] + [rng.randint(0, 10**7) / 20 for _ in range(2000)]
    rows = [(v,) for v in values]
    for digits in (1, 2):
        got = one(rounding.round_exact(F.col("v"), digits), rows, "v double")
        wrong = [(v, g) for v, g in zip(values, got) if g != round(v, digits)]
        assert not wrong, wrong[:5]
    shares = [(k / 2000,) for k in range(2001)]
    assert one(text.percent(F.col("v")), shares, "v double") == [f"{v:.1%}" for (v,) in shares]
    assert one(rounding.round_exact(F.col("v"), 1), [(None,), (float("inf"),)], "v double") == [
        None, float("inf")]


def test_numbers_as_text(one):
    values = [70.0, 12.5, 12345678.9, 1e7, 123456789012345.0, 0.0005, 0.00012, -2.5e8, 0.001, 0.0, 98765432.125]
    got = one(rounding.plain_number(F.col("v")), [(v,) for v in values], "v double")
    assert got == [repr(v) for v in values]

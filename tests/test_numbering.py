import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from answergauge.operators.numbering import first_rows, number_rows, rows_at, source_order
from answergauge.operators.sampling import sample_exact, weekly_sample


@pytest.mark.parametrize("levels,bits", [(0, 2), (1, 1), (2, 3), (1, 20)])
def test_positions_match_a_plain_sort(spark, levels, bits):
    rng = random.Random(levels)
    keys = defaultdict(set)
    for _ in range(300):
        run = rng.choice("aaab")
        keys[run].add(rng.choice([rng.randint(-40, 200), rng.randint(-2**62, 2**62)]))
    rows = [(run, k, f"text {k}") for run, ks in keys.items() for k in ks]
    df = spark.createDataFrame(rows, "run string, k bigint, t string")
    got = {(r.run, r.k): r.row_no for r in number_rows(df, "run", "k", bits=bits, levels=levels).collect()}
    assert len(got) == len(rows)
    for run, ks in keys.items():
        assert [got[run, k] for k in sorted(ks)] == list(range(1, len(ks) + 1))


def test_rows_without_a_key_keep_file_order(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    path.write_text("".join(f'{{"question": "q{i}"}}\n' for i in range(40)))
    rows = source_order(spark.read.schema("question string").json(str(path))).withColumn("run", F.lit("r"))
    got = {r.question: r.row_no for r in number_rows(rows, "run", "position").collect()}
    assert got == {f"q{i}": i + 1 for i in range(40)}


def test_numbering_of_nothing(spark):
    df = spark.createDataFrame([], "run string, k bigint")
    assert number_rows(df, "run", "k").count() == 0


def test_first_and_chosen_rows(spark):
    df = spark.createDataFrame([(r, k) for r in "ab" for k in (5, 3, 9, 1)], "run string, k bigint")
    first = first_rows(df, "run", [F.col("k")], 2)
    assert sorted((r.run, r.k, r.row_no) for r in first.collect()) == [
        ("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("b", 3, 2)]
    chosen = rows_at(number_rows(df, "run", "k"), [1, 4])
    assert sorted((r.run, r.k) for r in chosen.collect()) == [("a", 1), ("a", 9), ("b", 1), ("b", 9)]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(500).withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,id % 21)"))
    a = [r.id for r in sample_exact(df, "id", 40, "s").collect()]
    assert a == [r.id for r in sample_exact(df.repartition(7), "id", 40, "s").collect()]
    assert len(set(a)) == 40 and a != [r.id for r in sample_exact(df, "id", 40, "other").collect()]
    assert sample_exact(df.limit(3), "id", 40, "s").count() == 3
    weeks = weekly_sample(df, "ts", "id", 10, "s").groupBy("week").count().collect()
    assert len(weeks) == 3 and all(r["count"] == 10 for r in weeks)


@pytest.mark.parametrize("n", [3, 1001, 5000])
def test_first_rows_of_any_number(spark, n):
    rows = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), "id")
    cut = first_rows(rows, "g", [F.desc("id")], n)
    got = {}
    for r in cut.collect():
        got.setdefault(r.g, []).append((r.row_no, r.id))
    for g, found in got.items():
        ids = sorted((r.id for r in rows.collect() if r.g == g), reverse=True)[:n]
        assert sorted(found) == list(enumerate(ids, 1))
    # a rank filter below the shuffle by group alone
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") >= 2

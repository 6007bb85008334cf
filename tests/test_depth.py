"""Deep positions, large samples, tested biases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from answergauge.operators.agreement import bias_alarm_tested, holm, sign_test
from answergauge.operators.numbering import first_rows, number_rows, rows_at_positions
from answergauge.operators.sampling import sample_exact, sample_large


def test_positions_equal_numbering(spark):
    rng = random.Random(3)
    rows = [("hot", k) for k in rng.sample(range(-5000, 100000), 3000)] + [(f"r{i % 7}", i * 13) for i in range(90)]
    df = spark.createDataFrame(rows, "run string, key long")
    wanted = [1, 2, 13, 500, 2999, 3000, 3001]
    got = rows_at_positions(df, "run", "key", wanted, bits=8)
    full = number_rows(df, "run", "key").where(F.col("row_no").isin(wanted))
    assert sorted(got.select("run", "key", "row_no").collect()) == sorted(full.select("run", "key", "row_no").collect())


def test_two_positions_move_two_buckets(spark):
    """Of a run of 40 buckets, the rows of two are ranked."""
    df = spark.range(40_000).select(F.lit("a").alias("run"), F.col("id").alias("key"))
    got = rows_at_positions(df, "run", "key", [1, 30_000], bits=10)
    assert [tuple(r) for r in got.orderBy("key").collect()] == [("a", 0, 1), ("a", 29_999, 30_000)]
    # what is ranked comes out of the join with the two buckets, not from the table
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window \[row_number.*\n.*\n?.*Join Inner", plan), plan
    ranked = df.withColumn("bucket", F.shiftright("key", 10)).where("bucket IN (0, 29)")
    assert ranked.count() == 2048


def test_a_row_without_a_run_fails(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "run string, key long")
    for op in (lambda: number_rows(df, "run", "key"), lambda: rows_at_positions(df, "run", "key", [1])):
        with pytest.raises(Exception, match="a row has no run"):
            op().collect()


def test_first_rows_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "run string, key long").repartition(5)
    assert first_rows(df, "run", [F.col("key")], 10).groupBy("run").count().collect().__len__() == 2
    assert first_rows(df, "run", [F.col("key")], 10).count() == 11


@pytest.mark.parametrize("n", [0, 1, 37, 4999, 5000, 6000])
def test_large_samples_equal_exact_ones(spark, n):
    df = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("extra"))
    for digits in (1, 3):
        got = sample_large(df, "key", n, "seed", digits=digits)
        assert sorted(got.collect()) == sorted(sample_exact(df, "key", n, "seed").collect()) and got.columns == df.columns


def test_samples_per_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 50, "small").otherwise("big").alias("run"))
    got = sample_large(df, "key", 100, "s", by=["run"]).collect()
    for run in (None, "small", "big"):
        own = df.where(F.col("run").eqNullSafe(run))
        assert sorted(r.key for r in got if r.run == run) == sorted(r.key for r in sample_exact(own, "key", 100, "s").collect())


def test_large_samples_rank_one_digit_group(spark):
    plan = sample_large(spark.range(100_000), "id", 50_000, "s")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan
    assert re.search(r"row_number\(\) windowspecdefinition\(_digits", plan)


def _exact(up, down):
    n, k = up + down, min(up, down)
    term = total = 1
    for i in range(k):
        term = term * (n - i) // (i + 1)
        total += term
    return min(1.0, 2 * total / 2 ** n)


def test_sign_test_equals_whole_numbers(spark):
    cases = [(u, d) for u in range(0, 40, 3) for d in range(0, 40, 4)] + [(500, 430), (1000, 1000), (3000, 2700), (900, 3)]
    df = spark.createDataFrame(cases, "up long, down long").withColumn("p", sign_test(F.col("up"), F.col("down")))
    for r in df.collect():
        assert r.p == pytest.approx(_exact(r.up, r.down), rel=1e-9), r
    huge = spark.createDataFrame([(5_000_000_000, 5_000_200_000)], "up long, down long")
    p = huge.select(sign_test(F.col("up"), F.col("down"))).first()[0]
    assert p == pytest.approx(math.erfc(200_000 / math.sqrt(1.00002e10) / math.sqrt(2)), rel=1e-3)


def test_holm_correction(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.005), ("g", 0.04), ("h", 0.6), ("h", 0.6)], "family string, p double")
    got = {(r.family, r.p): r.p_adjusted for r in holm(df, ["family"], "p").collect()}
    expected = {("f", 0.005): 0.02, ("f", 0.01): 0.03, ("f", 0.03): 0.06, ("f", 0.04): 0.06, ("g", 0.04): 0.04, ("h", 0.6): 1.0}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_tested_alarm(spark):
    pairs = [("en", "tone", "bad", "good")] * 9 + [("en", "tone", "good", "good")] * 5 + [("en", "length", "ok", "good")] * 3 \
        + [("en", "length", "good", "ok")] * 2 + [("en", "length", "bad", "ERROR")]
    got = {r.criterion: r for r in bias_alarm_tested(
        spark.createDataFrame(pairs, "lang string, criterion string, human string, judge string"), ["lang"], ["criterion"]).collect()}
    assert got["tone"].alarm and got["tone"].p_adjusted == pytest.approx(2 * 2 / 2 ** 9)
    assert not got["length"].alarm and got["length"].p_value == 1.0

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from answergauge.operators import runs as rn


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "x", "good"), (2, "y", "ok"), (3, None, "bad")], "n int, t string, v string")
    b = spark.createDataFrame([(2, "y", "good"), (3, None, "bad"), (4, "w", "ok"), (1, "X", "good")],
                              "n int, t string, v string")
    return a, b


def test_diff_partitions_the_outer_rows(sides):
    a, b = sides
    aligned = rn.align_runs(a.where("n < 3"), b, ["n"], ["t", "v"])
    got = {r.n: r.s for r in aligned.withColumn("s", rn.diff_status("t")).collect()}
    assert got == {1: "changed", 2: "unchanged", 3: "only_right", 4: "only_right"}
    aligned = rn.align_runs(a, b, ["n"], ["t"], carry=["v"]).withColumn("s", rn.diff_status("t"))
    assert {r.n: (r.v, r.s) for r in aligned.collect()} == {
        1: ("good", "changed"), 2: ("ok", "unchanged"), 3: ("bad", "unchanged"), 4: ("ok", "only_right")}


def test_set_operations(sides):
    a, b = sides
    assert sorted(r.n for r in rn.unchanged_rows(a, b, ["n", "t"]).collect()) == [2, 3]
    changed = {(r.k, r.side, r.n) for r in rn.changed_rows(
        a.union(a).withColumnRenamed("n", "k"), b.withColumnRenamed("n", "k"), ["k", "t"]).collect()}
    assert changed == {
        (1, "left", 2), (2, "left", 1), (3, "left", 1), (1, "right", 1), (4, "right", 1)}
    stacked = rn.stack_runs({"A": a, "B": b.drop("v")})
    assert stacked.count() == 7 and stacked.where("source_run = 'B' and v is null").count() == 4


def test_transitions_and_flips(sides):
    a, b = sides
    aligned = rn.align_runs(a, b, ["n"], ["v"])
    got = {(r.from_verdict, r.to_verdict): r.n for r in rn.transitions(aligned, [], "v").collect()}
    assert got == {("good", "good"): 1, ("ok", "good"): 1, ("bad", "bad"): 1}
    assert [r.n for r in rn.flips(aligned, "v").collect()] == [2]


def test_unrated_changes_and_rated_in_both(sides, spark):
    a, b = sides
    rated = spark.createDataFrame([(1,), (2,)], "n int")
    changed = rn.align_runs(a, b, ["n"], ["t"]).where(rn.diff_status("t") != "unchanged").select("n")
    assert [r.n for r in rn.changed_but_unrated(changed, rated, ["n"]).collect()] == [4]
    assert sorted(r.n for r in rn.rated_in_both(a, b, ["n"]).collect()) == [1, 2, 3]


def test_distribution_adds_up_and_delta(spark):
    rng = random.Random(3)
    words = ["good", "ok", "bad", "ERROR", None, ""]
    rows = [(rng.choice(["base", "next"]), rng.choice("ab"), rng.choice(words)) for _ in range(400)]
    df = spark.createDataFrame(rows, "run string, criterion string, verdict string")
    dist = rn.verdict_distribution(df, ["run", "criterion"])
    for r in dist.collect():
        mine = [v for run, c, v in rows if (run, c) == (r.run, r.criterion)]
        assert (r.n_good, r.n_ok, r.n_bad) == tuple(mine.count(v) for v in ("good", "ok", "bad"))
        assert r.n_good + r.n_ok + r.n_bad + r.n_other == len(mine)
    delta = {(r.run, r.criterion): r for r in rn.delta_vs_baseline(dist, "run", "base", "criterion").collect()}
    assert delta["base", "a"].delta_good == 0
    assert delta["next", "a"].delta_good == delta["next", "a"].n_good - delta["base", "a"].n_good


def test_pass_rates_with_totals(spark):
    df = spark.createDataFrame(
        [("r1", "x", "pass"), ("r1", "y", "fail"), ("r2", "x", "pass"), ("r2", "x", "ERROR")],
        "run string, cat string, score string")
    rows = {(r.run, r.cat, r.level): (r.n, r.n_pass) for r in rn.breakdown(df, "run", "cat", "score").collect()}
    assert rows[None, None, 3] == (4, 2) and rows["r1", None, 1] == (2, 1) and rows["r2", "x", 0] == (2, 1)
    rate = {r.run: r.pass_rate for r in rn.pass_rate(df, ["run"], "score").collect()}
    assert rate == {"r1": 0.5, "r2": 0.5}


def test_published_latency_and_token_changes(spark):
    old = spark.createDataFrame([("r", 1713.0, 77.6)], "run string, ms double, tokens double")
    new = spark.createDataFrame([("r", 1038.0, 49.2)], "run string, ms double, tokens double")
    row = rn.relative_change(old, new, ["run"], ["ms", "tokens"]).first()
    assert round(row.change_ms, 2) == -0.39 and round(row.change_tokens, 2) == -0.37
    zero = rn.relative_change(old.withColumn("ms", F.lit(0.0)), new, ["run"], ["ms"]).first()
    assert zero.change_ms is None


def test_latency_summary_and_token_cap(spark):
    df = spark.createDataFrame([("r", 1000.0, 70), ("r", 1999.9, 71), ("r", 11275.0, 10), ("r", None, 70)],
                               "run string, ms double, tokens int")
    row = rn.latency_summary(df, ["run"], "ms", 2000, 5000).first()
    assert (row.n, row.n_under, row.n_outliers, row.max_ms) == (3, 2, 1, 11275.0)
    cap = rn.token_cap_counts(df, ["run"], "tokens", 70).first()
    assert (cap.n, cap.n_over, cap.n_at_cap) == (4, 1, 2)


def test_cost_and_capacity(spark):
    usage = spark.createDataFrame([("m", "r", 5287, 293)], "model string, run string, input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, price_in double, price_out double")
    assert round(rn.cost_by(usage, prices, "model", ["run"]).first().cost_per_row, 4) == 0.0135
    unpriced = usage.unionByName(usage.withColumn("model", F.lit("new")))
    row = rn.cost_by(unpriced, prices, "model", ["run"]).first()
    assert (row.n, row.n_unpriced, row.input_tokens, round(row.cost, 6)) == (2, 1, 10574, 0.013504)
    rated = spark.range(52).select(F.lit("r").alias("run"), F.lit(30 * 60 / 52).alias("s"))
    assert round(rn.capacity(rated, ["run"], "s", 5000).first().hours_for_volume, 1) == 48.1


def test_rating_drift(spark):
    df = spark.createDataFrame([("h1", "a", "good"), ("h1", "a", "ok"), ("h1", "a", "good"), ("h2", "a", "bad"),
                                ("h2", "a", "bad"), ("h3", "a", "bad"), ("h3", "a", None)],
                               "h string, criterion string, verdict string")
    got = {r.h: (r.n, r.distinct_verdicts) for r in rn.rating_drift(df, "h", ["criterion"]).collect()}
    assert got == {"h1": (3, 2), "h2": (2, 1)}


@pytest.mark.parametrize("seed", [1, 5])
def test_carry_over_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        # one text holds a third of all rows
        text = "hot" if i % 3 == 0 else f"t{rng.randint(0, 60)}"
        rows.append((i, text, rng.choice(["good", "ok"]) if rng.random() < 0.1 and text != "hot" else None))
    rows.append((400, "hot", "bad"))
    known = defaultdict(set)
    for _, text, v in rows:
        if v:
            known[text].add(v)
    expected = {i: next(iter(known[t])) if len(known[t]) == 1 else None for i, t, v in rows if v is None}
    df = spark.createDataFrame(rows, "id int, h string, v string")
    got = {r.id: r.carried_verdict for r in rn.carry_ratings(df, "id", "h", "v").collect()}
    assert got == expected

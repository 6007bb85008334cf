"""Seeded random verdict tables, Spark against DuckDB."""

import random

import duckdb
import pandas as pd
import pytest

from answergauge.operators import agreement as ag
from answergauge.operators import runs as rn

WORDS = ["good", "ok", "bad", "goood", "bda", "ERROR", "", None]


def _rows(seed):
    rng = random.Random(seed)
    return [
        (f"r{rng.randint(0, 3)}", i, rng.choice("abc"), rng.choice(WORDS), rng.choice(WORDS))
        for i in range(rng.randint(50, 400))
    ]


@pytest.mark.parametrize("seed", range(4))
def test_agreement_and_distribution(spark, seed):
    rows = _rows(seed)
    names = ["run", "row_no", "criterion", "h", "j"]
    df = spark.createDataFrame(rows, "run string, row_no int, criterion string, h string, j string")
    con = duckdb.connect()
    con.register("sheet", pd.DataFrame(rows, columns=names))

    pairs = ag.pair_columns(df.withColumnRenamed("criterion", "c"), ["run", "c"], {"x": ("h", "j")})
    got = sorted((r.run, r.c, r.n, round(r.agreement, 9), round(r.bias, 9), r.disagreements,
                  r.more_generous, r.harsher) for r in ag.agreement(pairs, ["run", "c"]).collect())
    expected = con.execute("""
        WITH p AS (SELECT run, criterion, CASE h WHEN 'goood' THEN 'good' WHEN 'bda' THEN 'bad' ELSE h END AS h, j
                   FROM sheet),
        o AS (SELECT *, list_position(['bad', 'ok', 'good'], j) - list_position(['bad', 'ok', 'good'], h) AS gap
              FROM p WHERE h IN ('good', 'ok', 'bad') AND j IN ('good', 'ok', 'bad'))
        SELECT run, criterion, count(*), round(avg((h = j)::INT), 9), round(avg(gap), 9),
          count(*) FILTER (WHERE h <> j), count(*) FILTER (WHERE gap > 0), count(*) FILTER (WHERE gap < 0)
        FROM o GROUP BY ALL ORDER BY ALL""").fetchall()
    assert got == expected

    dist = rn.verdict_distribution(df.withColumnRenamed("j", "verdict"), ["run"])
    got = sorted(tuple(r) for r in dist.select("run", "n_good", "n_ok", "n_bad", "n_other").collect())
    expected = con.execute("""
        SELECT run, count(*) FILTER (WHERE j = 'good'), count(*) FILTER (WHERE j = 'ok'),
          count(*) FILTER (WHERE j = 'bad'),
          count(*) FILTER (WHERE j IS NULL OR j NOT IN ('good', 'ok', 'bad'))
        FROM sheet GROUP BY run ORDER BY run""").fetchall()
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_outer_rows_are_partitioned(spark, seed):
    rng = random.Random(100 + seed)

    def side():
        return [(i, rng.choice(["x", "y", None])) for i in range(200) if rng.random() < 0.8]

    a, b = side(), side()
    schema = "k int, t string"
    aligned = rn.align_runs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ["t"])
    counts = {r.s: r["count"] for r in aligned.groupBy(rn.diff_status("t").alias("s")).count().collect()}
    left, right = dict(a), dict(b)
    both = left.keys() & right.keys()
    assert counts == {
        "only_left": len(left.keys() - right.keys()), "only_right": len(right.keys() - left.keys()),
        "unchanged": sum(left[k] == right[k] for k in both),
        "changed": sum(left[k] != right[k] for k in both)}

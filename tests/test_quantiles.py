import math
import random

import duckdb
import pytest

from answergauge.operators import quantiles as qt
from answergauge.session import written

SHARES = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def _store(df):
    return written(df, "test")


def _values(kind, n=4000):
    rng = random.Random(kind)
    return {
        "skewed": [rng.lognormvariate(6, 2) for _ in range(n)],
        "signed": [rng.gauss(0, 1000) for _ in range(n)] + [0.0, -0.0] * 50,
        "tied": [rng.choice([1.0, 2.0, 2.0000000001, 1e300, 5e-324]) for _ in range(n)],
        "narrow": [1000 + rng.random() * 1e-9 for _ in range(n)],
        "one": [42.0]}[kind]


def _rank(values, share):
    return sorted(values)[max(1, math.ceil(share * len(values))) - 1]


@pytest.mark.parametrize("kind", ["skewed", "signed", "tied", "narrow", "one"])
def test_exact_and_bounds(spark, kind):
    groups = {"a": _values(kind), None: _values(kind)[:7]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "run string, ms double")
    exact = qt.exact_quantiles(df, ["run"], "ms", SHARES, _store).collect()
    assert {(r.run, r.share): r.value for r in exact} == {
        (g, s): _rank(values, s) for g, values in groups.items() for s in SHARES}
    bounds = qt.sketch_quantiles(qt.quantile_sketch(df, ["run"], "ms"), ["run"], SHARES).collect()
    assert len(bounds) == len(groups) * len(SHARES)
    for r in bounds:
        true = _rank(groups[r.run], r.share)
        assert r.low <= true <= r.high and r.n == len(groups[r.run])
        assert abs(r.high - r.low) <= abs(r.high) * 0.011 + 1e-300
        inside = sum(r.low <= v <= r.high for v in groups[r.run])
        assert r.rank_error == inside / r.n


def test_merged_sketches_equal_one_pass(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 9}", i % 3, rng.lognormvariate(6, 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "run string, day int, ms double")
    parts = [_store(qt.quantile_sketch(df.where(f"day = {d}"), ["run"], "ms")) for d in range(3)]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for by in (["run"], []):
        one = qt.quantile_sketch(df, by, "ms")
        assert sorted(qt.merge_sketches(stacked, by).collect()) == sorted(one.select(*by, "bucket", "n", "low", "high").collect())


def test_rank_error_against_another_engine(spark):
    values = _values("skewed", 20000)
    df = spark.createDataFrame([("a", v) for v in values], "run string, ms double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS v", [values])
    for r in qt.sketch_quantiles(qt.quantile_sketch(df, ["run"], "ms"), ["run"], (0.5, 0.95, 0.99)).collect():
        true, = con.execute(f"SELECT quantile_disc(v, {r.share}) FROM t").fetchone()
        below, = con.execute("SELECT count(*) FROM t WHERE v <= ?", [r.high]).fetchone()
        assert r.low <= true <= r.high and abs(below / r.n - r.share) <= r.rank_error


def test_columns_and_empty_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "run string, ms double")
    wide = qt.in_columns(qt.exact_quantiles(df, ["run"], "ms", (0.5, 0.999), _store), ["run"], (0.5, 0.999), "value")
    assert [tuple(r) for r in wide.collect()] == [("a", 2, 1.0, 3.0)] and wide.columns == ["run", "n", "p50", "p99_9"]
    assert qt.exact_quantiles(df.where("false"), ["run"], "ms", (0.5,), _store).count() == 0

"""Quantiles of a measure per group from mergeable sketches, and exact ones from those.

A sketch is a small table: for each group and value bucket the number of values,
the least and the greatest. Buckets are steps of a logarithm, so their number
depends on the range of the values and never on how many there are. Sketches of
different runs, days or files merge by adding rows of equal buckets; the result
is the same as that of one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64  # buckets per doubling of the value: a bucket is 1.1 % wide
DOUBLINGS = 1100  # beyond those of any double, so that buckets keep the order of the values
PARTS = 4096  # an unresolved range is cut into so many on each further pass


def bucket_of(value: Column, steps: int = STEPS) -> Column:
    """Bucket of a value; a greater value never has a lesser bucket."""
    magnitude = F.floor(F.log2(F.abs(value)) * steps).cast("bigint") + DOUBLINGS * steps
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0).cast("bigint"))


def quantile_sketch(df: DataFrame, by: list[str], value: str, steps: int = STEPS) -> DataFrame:
    """(by, bucket, n, low, high). Missing and NaN values are left out; one aggregation, combined before the shuffle."""
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("_x"))
    return rows.groupBy(*by, bucket_of(F.col("_x"), steps).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of any number of runs, stacked, as sketches of the groups ``by``."""
    return sketches.groupBy(*by, "bucket").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def sketch_quantiles(sketch: DataFrame, by: list[str], shares: Sequence[float]) -> DataFrame:
    """(by, share, n, rank, low, high, rank_error): one row per group and share.

    The value of rank ``ceil(share * n)`` lies between ``low`` and ``high``, both
    of them values of the group. ``rank_error`` is the share of the group's values
    that lie in that bucket: taking any value of the range for the quantile is off
    by less than that in rank, and by less than the bucket's width in value. Where
    ``low = high`` the quantile is exact. The window sees the buckets of a group,
    whose number does not depend on the rows.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(group)})
    wanted = ranked.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_all"))))
    met = wanted.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank")))
    return met.select(
        *by, "share", F.col("_all").alias("n"), "rank", "low", "high",
        (F.col("n") / F.col("_all")).alias("rank_error"), (F.col("_upto") - F.col("n")).alias("_below"))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, shares: Sequence[float],
    store: Callable[[DataFrame], DataFrame], sketch: DataFrame | None = None,
) -> DataFrame:
    """(by, share, n, rank, value): the value of rank ``ceil(share * n)`` itself, without sorting a group.

    The sketch says which bucket holds a rank. Values of such buckets are counted
    again in 4096 parts of the range between the least and the greatest of them,
    until a range is one value; that takes at most five passes of which all but
    the first keep only rows of the wanted ranges. ``store`` writes a small table
    and reads it back (it has a row per group and share), so that no pass repeats
    another's work.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("_x"))
    first = quantile_sketch(df, by, value) if sketch is None else sketch
    state = store(sketch_quantiles(first, by, shares).drop("rank_error"))
    done = [state.where("low = high")]
    while not (open_ranges := state.where("low < high")).isEmpty():
        same = [rows[c].eqNullSafe(open_ranges[c]) for c in by]
        inside = reduce(lambda a, b: a & b, [*same, rows["_x"].between(open_ranges["low"], open_ranges["high"])])
        wide = (open_ranges["high"] - open_ranges["low"]) / PARTS
        part = F.least(F.lit(PARTS - 1), F.floor((rows["_x"] - open_ranges["low"]) / wide))
        # the upper end is a part of its own, so that every pass makes each range smaller
        part = F.when(rows["_x"] == open_ranges["high"], F.lit(PARTS)).otherwise(part)
        counted = rows.join(open_ranges, inside).select(
            *[rows[c] for c in by], "share", open_ranges["n"], "rank", "_below", part.alias("bucket"), "_x"
        ).groupBy(*by, "share", "n", "rank", "_below", "bucket").agg(
            F.count(F.lit(1)).alias("_in"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        upto = Window.partitionBy(*by, "share").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(upto), F.lit(0)))
        state = store(placed.where(
            (F.col("_below") < F.col("rank")) & (F.col("_below") + F.col("_in") >= F.col("rank"))
        ).select(*by, "share", "n", "rank", "low", "high", "_below"))
        done.append(state.where("low = high"))
    found = reduce(DataFrame.unionByName, done)
    return found.select(*by, "share", "n", "rank", F.col("low").alias("value"))


def in_columns(quantiles: DataFrame, by: list[str], shares: Sequence[float], *values: str) -> DataFrame:
    """One row per group, a column such as ``p95`` (or ``p95_low``) per share and value."""
    def name(share: float, value: str) -> str:
        return f"p{f'{share * 100:g}'.replace('.', '_')}" + ("" if value == "value" else f"_{value}")

    return quantiles.groupBy(*by).agg(
        F.max("n").alias("n"),
        *(F.max(F.when(F.col("share") == s, F.col(v))).alias(name(s, v)) for s in shares for v in values))

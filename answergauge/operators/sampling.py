"""Repeatable samples: the order is a hash of the row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.operators.numbering import first_rows


def sample_order(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))


def sample_exact(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when there are fewer)."""
    return df.orderBy(sample_order(key, seed), key).limit(n)


def sample_large(df: DataFrame, key: str, n: int, seed: str, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """The rows of ``sample_exact``, or those of each group ``by``, for an ``n`` of any size.

    No order of all rows: a histogram over the leading hex digits of the hash
    (4096 numbers per group) tells below which of them lies the n-th row. Rows
    of lower digits are in as they are, in place; only those of the one digit
    group where the n-th row falls are ranked, a 4096th of the rows.
    """
    by = by or []
    order = sample_order(key, seed)
    rows = df.withColumns({"_order": order, "_digits": F.substring(order, 1, digits)})
    counts = rows.groupBy(*by, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*by).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_left", F.lit(n) - F.coalesce(F.sum("_n").over(lower), F.lit(0))).where("_left > 0")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by] + [F.col("r._digits") == F.col("c._digits")]

    def taken(part: DataFrame) -> DataFrame:
        return rows.alias("r").join(part.alias("c"), same).select("r.*", "c._left")

    whole = taken(needed.where("_n <= _left")).drop("_left")
    cut = taken(needed.where("_n > _left"))
    place = F.row_number().over(Window.partitionBy(*by, "_digits").orderBy("_order", key))
    cut = cut.withColumn("_place", place).where("_place <= _left").drop("_place", "_left")
    return whole.unionByName(cut).drop("_order", "_digits")


def weekly_sample(df: DataFrame, ts: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` audit rows per calendar week (Monday start)."""
    weekly = df.withColumn("week", F.date_trunc("week", F.col(ts)))
    return first_rows(weekly, "week", [sample_order(key, seed), F.col(key)], n, out="audit_no")

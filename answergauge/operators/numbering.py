"""Positions inside a run, without ever sorting a whole run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Key values per bucket, as a power of two: a million rows at most.
SPAN_BITS = 20


def _bucket(key: str, bits: int) -> Column:
    """Floor of key / 2^bits. Declared non-NULL, so that the joins below add no
    filters and Spark can reuse one exchange of the counts."""
    return F.coalesce(F.shiftright(F.col(key), bits), F.lit(0).cast("bigint"))


def _rows_before(counts: DataFrame, run: str, levels: int, bits: int) -> DataFrame:
    """(run, bucket, n) -> (run, bucket, before): rows in lower buckets."""
    def running(*parts: str) -> Column:
        lower = Window.partitionBy(*parts).orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(lower), F.lit(0))

    if levels == 0:
        return counts.select(run, "bucket", running(run).alias("before"))
    parted = counts.withColumn("parent", _bucket("bucket", bits))
    totals = parted.groupBy(run, F.col("parent").alias("bucket")).agg(F.sum("n").alias("n"))
    upper = _rows_before(totals, run, levels - 1, bits).select(
        run, F.col("bucket").alias("parent"), F.col("before").alias("above"))
    return (
        parted.withColumn("inside", running(run, "parent"))
        .join(upper, [run, "parent"])
        .select(run, "bucket", (F.col("above") + F.col("inside")).alias("before"))
    )


def number_rows(
    df: DataFrame, run: str, key: str, out: str = "row_no", bits: int = SPAN_BITS, levels: int = 1
) -> DataFrame:
    """Consecutive 1-based position of each row of a run, ordered by an integer key.

    One run may hold a third of all rows, so the rank is built in two parts:
    the rank inside a bucket of ``2**bits`` consecutive key values, plus the
    number of rows in lower buckets. The key is unique in its run, so a bucket
    is bounded whatever the skew. The bucket counts are summed up the same way:
    with the defaults the last window sees at most 2^24 narrow rows per run for
    any 64-bit key, and only a handful for dense ids. A row without a run or a key fails the job.
    """
    df = _set(df, run, key)
    bucketed = df.withColumn("bucket", _bucket(key, bits))
    counts = (
        df.select(run, _bucket(key, bits).alias("bucket"))
        .groupBy(run, "bucket").agg(F.count(F.lit(1)).alias("n"))
    )
    inside = Window.partitionBy(run, "bucket").orderBy(key)
    return (
        bucketed.withColumn("inside", F.row_number().over(inside))
        .join(_rows_before(counts, run, levels, bits), [run, "bucket"])
        .withColumn(out, (F.col("before") + F.col("inside")).cast("bigint"))
        .drop("bucket", "inside", "before")
    )


def _set(df: DataFrame, *columns: str) -> DataFrame:
    """The rows as they are; a NULL in one of the columns fails the job."""
    return df.withColumns({c: F.coalesce(c, F.raise_error(F.lit(f"a row has no {c}")).cast(df.schema[c].dataType)) for c in columns})


def rows_at_positions(
    df: DataFrame, run: str, key: str, positions: list[int], out: str = "row_no", bits: int = SPAN_BITS, levels: int = 1
) -> DataFrame:
    """Rows at chosen 1-based positions of every run, however deep, as ``number_rows`` counts them.

    The counts of the buckets, ranges of ``2**bits`` key values, say which of
    them hold a wanted position; only rows of those buckets are moved and
    ranked, one bucket per run and position at most.
    """
    df = _set(df, run, key)
    counts = df.select(run, _bucket(key, bits).alias("bucket")).groupBy(run, "bucket").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.join(_rows_before(counts, run, levels, bits), [run, "bucket"])
    listed = F.array(*(F.lit(p).cast("bigint") for p in sorted(set(positions))))
    holding = placed.withColumn("_wanted", F.filter(
        listed, lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("n")))).where(F.size("_wanted") > 0)
    inside = Window.partitionBy(run, "bucket").orderBy(key)
    met = df.withColumn("bucket", _bucket(key, bits)).join(holding.select(run, "bucket", "before", "_wanted"), [run, "bucket"])
    numbered = met.withColumn(out, (F.col("before") + F.row_number().over(inside)).cast("bigint"))
    return numbered.where(F.array_contains("_wanted", F.col(out))).drop("bucket", "before", "_wanted")


def source_order(df: DataFrame, out: str = "position") -> DataFrame:
    """A unique integer that grows in file order, for rows that come without a key.

    It depends on how the files are split: assign it once, directly on the scan,
    and store it; ``number_rows`` makes it consecutive.
    """
    return df.withColumn(out, F.monotonically_increasing_id())


def first_rows(
    df: DataFrame, group: str, order: list, n: int, out: str = "row_no", spread: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group, for any ``n``.

    A group is first cut to ``n`` rows in each of ``spread`` buckets of its rows'
    hashes, so that a hot group is sorted in ``spread`` tasks and the final rank
    sees ``spread * n`` rows of it at most. Spark's own group limit, which acts
    before the shuffle, only covers ranks up to a thousand. Equal rows are dealt
    by the task that reads them, so copies of one row do not share a bucket.
    """
    hashed = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(spread)))
    part = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    cut = bucketed.withColumn("_part", part).where(F.col("_part") <= n).drop("_part", "_bucket")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return cut.withColumn(out, rank).where(F.col(out) <= n)


def rows_at(numbered: DataFrame, positions: list[int], row_no: str = "row_no") -> DataFrame:
    """Rows at chosen positions of every run."""
    return numbered.where(F.col(row_no).isin(positions))

"""Facts against their reference ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.functions.bands import NO_RANGE, STATUS_OUT, in_range, range_status


def with_range_status(
    facts: DataFrame, ranges: DataFrame, on: str, value: str,
    low: str = "reference_low", high: str = "reference_high",
) -> DataFrame:
    """Join facts to the range of their test and derive status and in-range flag.

    A fact without a range keeps its row, with the status ``NO_RANGE``.

    No broadcast is forced: Spark broadcasts the dimension when its size is
    under the threshold, and otherwise shuffles, where adaptive execution splits
    a hot test name.
    """
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    known = ranges.withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), range_status(v, lo, hi)).otherwise(NO_RANGE)
    return facts.join(known, on, "left").withColumns(
        {"status": status, "in_range": in_range(v, lo, hi)}).drop("_known")


def status_audit(df: DataFrame, stored: str, computed: str = "status") -> DataFrame:
    """Rows whose stored status is not the computed one; a missing one differs."""
    return df.where(~F.col(stored).eqNullSafe(F.col(computed)))


def out_of_range_rate(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Share of facts outside their range; facts without one are counted, but not in the rate."""
    ranged = F.col(status) != NO_RANGE
    out = F.col(status) == STATUS_OUT
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ranged).alias("n_no_range"),
        F.count_if(out).alias("n_oos"),
        F.avg(F.when(ranged, out.cast("double"))).alias("oos_rate"),
    )

"""Pass/fail of answers and the repair of judged sheets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions.bands import MAX_BAD, MIN_GOOD, VETO, final_score, latency_band
from answergauge.functions.verdicts import ERROR, blank_to_null, count_equal


def gate(
    df: DataFrame,
    verdicts: Mapping[str, str],
    latency_ms: str,
    failed: Column | None = None,
    prefix: str = "judge_",
    veto: str = VETO,
    min_good: int = MIN_GOOD,
    max_bad: int = MAX_BAD,
) -> DataFrame:
    """Add ``{prefix}{criterion}_verdict``, the latency band and the final score.

    ``verdicts`` maps a criterion to its input column. Where ``failed`` is true
    every verdict cell of the row, latency included, becomes ERROR; the other
    rows are not affected. One projection, no shuffle.
    """
    failed = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    cells = {c: F.when(failed, ERROR).otherwise(F.col(v)) for c, v in verdicts.items()}
    cells["latency"] = F.when(failed, ERROR).otherwise(latency_band(F.col(latency_ms)))
    named = {f"{prefix}{c}_verdict": col for c, col in cells.items()}
    out = df.withColumns(named)
    judged = {c: F.col(f"{prefix}{c}_verdict") for c in cells}
    return out.withColumns({
        f"{prefix}good_count": count_equal(judged.values(), "good"),
        f"{prefix}bad_count": count_equal(judged.values(), "bad"),
        f"{prefix}final_score": final_score(judged, veto, min_good, max_bad),
    })


def rated(df: DataFrame, anchor: str) -> DataFrame:
    """Rows a human rated: the anchor column is neither NULL nor blank."""
    return df.where(blank_to_null(F.col(anchor)).isNotNull())


def errored(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) == ERROR)


def error_counts(df: DataFrame, run: str, column: str) -> DataFrame:
    """Errored rows per run; clean runs do not appear."""
    return errored(df, column).groupBy(run).agg(F.count(F.lit(1)).alias("errors"))


def with_judge_columns(df: DataFrame, columns: list[str], mode: str = "fill") -> DataFrame:
    """Make sure the columns exist: ``replace`` resets them, ``fill`` adds absent ones."""
    if mode not in ("replace", "fill"):
        raise ValueError(f"unknown mode {mode}")
    wanted = columns if mode == "replace" else [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in wanted})


def upsert(
    sheet: DataFrame,
    updates: DataFrame,
    keys: list[str],
    columns: list[str],
    mode: str = "fill",
    only: Column | None = None,
) -> DataFrame:
    """Merge new cells back by key; rows without an update keep theirs.

    ``updates`` holds one row per key; two for one fail the job. ``replace`` starts from empty columns
    (a full run), ``fill`` from the present ones (a subset or a retry). ``only``
    restricts which sheet rows may take an update, read before the merge.
    """
    base = with_judge_columns(sheet, columns, mode)
    if only is not None:
        base = base.withColumn("_open", F.coalesce(only, F.lit(False)))
    else:
        base = base.withColumn("_open", F.lit(True))
    once = F.when(F.count(F.lit(1)) == 1, True).otherwise(F.raise_error(F.lit("two updates for one key")))
    new = updates.groupBy(*keys).agg(
        *[F.any_value(c).alias(f"_new_{c}") for c in columns], once.cast("boolean").alias("_hit"))
    take = F.col("_open") & F.col("_hit").isNotNull()
    merged = base.join(new, keys, "left").withColumns(
        {c: F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    return merged.drop("_open", "_hit", *[f"_new_{c}" for c in columns])


def retry_errors(
    sheet: DataFrame, rescored: DataFrame, keys: list[str], columns: list[str], error_column: str
) -> DataFrame:
    """Take re-scored cells for errored rows only. Running it twice changes nothing more."""
    return upsert(sheet, rescored, keys, columns, only=F.col(error_column) == ERROR)


def judge_subset(
    sheet: DataFrame, scored: DataFrame, keys: list[str], columns: list[str], anchor: str
) -> DataFrame:
    """Fill judge columns for human-rated rows, leave the others empty."""
    return upsert(
        sheet, scored, keys, columns, only=blank_to_null(F.col(anchor)).isNotNull())


def escalation(df: DataFrame, column: str) -> DataFrame:
    """Rows whose veto criterion is anything but good, a missing verdict included."""
    return df.where(~F.col(column).eqNullSafe("good"))


def final_score_distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Rows per final score, the most frequent first."""
    by = by or []
    return (
        df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, F.desc("n"), column)
    )

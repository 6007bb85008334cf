"""Comparing evaluation runs: distributions, alignment, text changes, drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.functions.text import text_hash
from answergauge.functions.verdicts import ORDINAL, VERDICTS, ordinal


def stack_runs(runs: Mapping[str, DataFrame], tag: str = "source_run") -> DataFrame:
    """UNION ALL of runs by column name, each row tagged with its run."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in runs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def melt(df: DataFrame, keys: list[str], columns: Mapping[str, str]) -> DataFrame:
    """Wide verdict columns to (keys, criterion, verdict); no shuffle."""
    cells = [
        F.struct(F.lit(c).alias("criterion"), F.col(v).alias("verdict"))
        for c, v in columns.items()
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def verdict_distribution(melted: DataFrame, by: list[str]) -> DataFrame:
    """good / ok / bad / other counts; a fixed column per verdict, one aggregation."""
    verdict = F.col("verdict")
    counts = [F.count_if(verdict == v).alias(f"n_{v}") for v in VERDICTS]
    other = F.count_if(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)))
    return melted.groupBy(*by).agg(*counts, other.alias("n_other"))


def delta_vs_baseline(distribution: DataFrame, run: str, baseline: str, on: str) -> DataFrame:
    """Change of the good count against the baseline run, per criterion.

    The input is one row per run and criterion, and is read once. Where the
    baseline has no row for a criterion both columns are NULL.
    """
    base = F.max(F.when(F.col(run) == baseline, F.col("n_good"))).over(Window.partitionBy(on))
    return distribution.withColumn("base_good", base).withColumn(
        "delta_good", F.col("n_good") - F.col("base_good"))


def pass_rate(df: DataFrame, by: list[str], final_score: str) -> DataFrame:
    passed = F.col(final_score) == "pass"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(passed).alias("n_pass"),
        F.avg(passed.cast("double")).alias("pass_rate"),
    )


def breakdown(df: DataFrame, run: str, category: str, final_score: str) -> DataFrame:
    """Pass rate per run and category, with run totals and a grand total."""
    passed = F.col(final_score) == "pass"
    return (
        df.select(run, category, passed.alias("_pass"))
        .rollup(run, category)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("_pass").alias("n_pass"),
            F.avg(F.col("_pass").cast("double")).alias("pass_rate"),
        )
    )


def latency_summary(df: DataFrame, by: list[str], latency_ms: str, limit: float, outlier: float) -> DataFrame:
    """Mean, maximum, share under a limit, rows beyond the outlier mark."""
    value = F.col(latency_ms)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_ms"),
        F.max(value).alias("max_ms"),
        F.count_if(value < limit).alias("n_under"),
        F.avg((value < limit).cast("double")).alias("share_under"),
        F.count_if(value > outlier).alias("n_outliers"),
    )


def relative_change(
    old: DataFrame, new: DataFrame, by: list[str], measures: list[str]
) -> DataFrame:
    """Relative change of the mean of each measure between two runs.

    Each run is averaged first; only the means are joined. A group that one run
    lacks keeps its row, without a change.
    """
    def means(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(*by).agg(*[F.avg(m).alias(f"{prefix}_{m}") for m in measures])

    joined = means(old, "old").join(means(new, "new"), by, "full_outer")
    return joined.withColumns({
        f"change_{m}": F.try_divide(F.col(f"new_{m}") - F.col(f"old_{m}"), F.col(f"old_{m}"))
        for m in measures
    })


def token_cap_counts(df: DataFrame, by: list[str], tokens: str, cap: int) -> DataFrame:
    """Rows above a token cap, and rows that end exactly at it."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(tokens) > cap).alias("n_over"),
        F.count_if(F.col(tokens) == cap).alias("n_at_cap"),
    )


def align_runs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    columns: list[str],
    carry: Sequence[str] = (),
    how: str = "full_outer",
) -> DataFrame:
    """Join two runs on the question key, ``{column}_a`` beside ``{column}_b``.

    ``in_a`` and ``in_b`` tell a missing row from a NULL cell. ``carry`` names
    columns that do not differ between the runs; leaving them out of the key
    lets the join reuse a partitioning by the key alone. Pass narrow columns
    (hashes, counts, verdicts) so that texts stay out of the shuffle.
    """
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *keys, F.lit(True).alias(f"in_{suffix}"),
            *[F.col(c).alias(f"{c}_{suffix}") for c in (*carry, *columns)])

    joined = side(left, "a").join(side(right, "b"), keys, how)
    present = {f"in_{s}": F.coalesce(f"in_{s}", F.lit(False)) for s in "ab"}
    shared = {c: F.coalesce(f"{c}_a", f"{c}_b") for c in carry}
    return joined.withColumns({**present, **shared}).drop(
        *[f"{c}_{s}" for c in carry for s in "ab"])


def with_text_hash(df: DataFrame, keys: list[str], text: str, *keep: str) -> DataFrame:
    return df.select(*keys, text_hash(F.col(text)).alias("text_hash"), *keep)


def diff_status(column: str = "text_hash") -> Column:
    """unchanged, changed, only_left or only_right of an aligned row."""
    return (
        F.when(~F.col("in_b"), "only_left")
        .when(~F.col("in_a"), "only_right")
        .when(F.col(f"{column}_a").eqNullSafe(F.col(f"{column}_b")), "unchanged")
        .otherwise("changed")
    )


def unchanged_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows equal in both runs."""
    return left.select(*columns).intersect(right.select(*columns))


def changed_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one run without an equal in the other: side and surplus copies ``n``.

    One aggregation over both runs, each read once; equal rows cancel out
    before the shuffle where they meet, NULL cells count as equal.
    """
    sides = left.select(*columns, F.lit(1).alias("_s")).unionByName(
        right.select(*columns, F.lit(-1).alias("_s")))
    surplus = sides.groupBy(*columns).agg(F.sum("_s").alias("_s")).where(F.col("_s") != 0)
    return surplus.select(
        *columns, F.when(F.col("_s") > 0, "left").otherwise("right").alias("side"),
        F.abs("_s").alias("n"))


def changed_but_unrated(changed: DataFrame, rated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a change touched that nobody rated."""
    return changed.join(rated, keys, "left_anti")


def rated_in_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def transitions(aligned: DataFrame, by: list[str], column: str) -> DataFrame:
    """Counts per (from, to) verdict of rows present in both runs."""
    both = aligned.where(F.col("in_a") & F.col("in_b"))
    return both.groupBy(
        *by, F.col(f"{column}_a").alias("from_verdict"), F.col(f"{column}_b").alias("to_verdict")
    ).agg(F.count(F.lit(1)).alias("n"))


def flips(aligned: DataFrame, column: str) -> DataFrame:
    """Rows present in both runs whose value differs."""
    same = F.col(f"{column}_a").eqNullSafe(F.col(f"{column}_b"))
    return aligned.where(F.col("in_a") & F.col("in_b") & ~same)


def rating_drift(melted: DataFrame, text_hash: str, by: list[str], min_rows: int = 2) -> DataFrame:
    """Identical texts and how many different verdicts they got.

    Verdicts come from a closed scale, so distinctness is a sum of three
    flags: it combines map-side, and a text copied millions of times still
    ships one row per task.
    """
    seen = F.lit(0)
    for v in VERDICTS:
        seen = seen + F.max(F.when(F.col("verdict") == v, 1).otherwise(0))
    return (
        melted.where(F.col("verdict").isin(*VERDICTS))
        .groupBy(text_hash, *by)
        .agg(F.count(F.lit(1)).alias("n"), seen.alias("distinct_verdicts"))
        .where(F.col("n") >= min_rows)
    )


def carry_ratings(answers: DataFrame, key: str, text_hash: str, verdict: str) -> DataFrame:
    """Give an unrated answer the rating of an identical rated text.

    ``answers`` has one narrow row per answer and is read twice. Texts with
    conflicting ratings carry nothing. A text may be copied into a third of all
    rows: both sides of the join come straight from a shuffle by the reversed
    hash, which no other step of the plan provides, so adaptive execution can
    split the hot partition.
    """
    # ordinals instead of words: minimum and maximum of numbers need no sort
    value = ordinal(F.col(verdict))
    per_text = answers.groupBy(text_hash).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    words = F.array(*[F.lit(v) for v in sorted(ORDINAL, key=ORDINAL.get)])
    known = per_text.where(F.col("_low") == F.col("_high")).select(
        F.reverse(text_hash).alias("_key"), F.get(words, F.col("_low")).alias("carried_verdict"))
    unrated = answers.where(F.col(verdict).isNull()).withColumn("_key", F.reverse(text_hash))
    return unrated.join(known, "_key", "left").drop("_key", verdict)


def cost_by(
    df: DataFrame, prices: DataFrame, on: str, by: list[str],
    input_tokens: str = "input_tokens", output_tokens: str = "output_tokens",
) -> DataFrame:
    """Cost from token counts and a price table in currency per million tokens.

    Rows without a price stay in the counts of rows and tokens, are reported as
    ``n_unpriced`` and add nothing to the cost.
    """
    row_cost = (
        F.col(input_tokens) * F.col("price_in") + F.col(output_tokens) * F.col("price_out")) / 1e6
    return df.join(prices, on, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(row_cost.isNull()).alias("n_unpriced"),
        F.sum(input_tokens).alias("input_tokens"),
        F.sum(output_tokens).alias("output_tokens"),
        F.sum(row_cost).alias("cost"),
        F.avg(row_cost).alias("cost_per_row"),
    )


def capacity(df: DataFrame, by: list[str], elapsed_s: str, volume: int) -> DataFrame:
    """Seconds per row so far, and the hours ``volume`` rows would take at that pace."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(elapsed_s).alias("elapsed_s"),
        F.avg(elapsed_s).alias("seconds_per_row"),
    ).withColumn("hours_for_volume", F.col("seconds_per_row") * volume / 3600)

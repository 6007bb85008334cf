"""Two raters on the same answers: alignment, agreement, bias, disagreements."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.functions.verdicts import VERDICTS, blank_to_null, in_domain, ordinal, repair
from answergauge.operators.numbering import first_rows

def pair_columns(
    sheet: DataFrame, keys: list[str], pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Melt a wide sheet into (keys, criterion, human, judge); no shuffle.

    ``pairs`` maps a criterion to its (human column, judge column). Typing slips
    are repaired here for comparison only, the sheet keeps its own values.
    """
    cells = [
        F.struct(
            F.lit(criterion).alias("criterion"),
            repair(blank_to_null(F.col(human))).alias("human"),
            F.col(judge).alias("judge"),
        )
        for criterion, (human, judge) in pairs.items()
    ]
    return sheet.select(*keys, F.inline(F.array(*cells)))


def align_raters(
    verdicts: DataFrame, keys: list[str], human: str = "human", judge: str = "judge"
) -> DataFrame:
    """Pair two raters of the long verdict table on (keys, criterion)."""
    on = [*keys, "criterion"]

    def of(rater: str, name: str, value: Column) -> DataFrame:
        return verdicts.where(F.col("rater") == rater).select(*on, value.alias(name))

    left = of(human, "human", repair(blank_to_null(F.col("verdict"))))
    return left.join(of(judge, "judge", F.col("verdict")), on)


def comparable(pairs: DataFrame) -> DataFrame:
    """Pairs where both verdicts are on the scale (drops blanks and ERROR)."""
    return pairs.where(in_domain(F.col("human")) & in_domain(F.col("judge")))


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pair count, agreement rate, bias and directions in one aggregation.

    An empty group does not appear; the rate of no rows is therefore NULL, not
    zero. Bias above zero means the second rater is more generous.
    """
    gap = ordinal(F.col("judge")) - ordinal(F.col("human"))
    return (
        comparable(pairs)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("human") == F.col("judge")).cast("double")).alias("agreement"),
            F.avg(gap).alias("bias"),
            F.count_if(F.col("human") != F.col("judge")).alias("disagreements"),
            F.count_if(gap > 0).alias("more_generous"),
            F.count_if(gap < 0).alias("harsher"),
        )
    )


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Count per (human, judge) combination."""
    return comparable(pairs).groupBy(*by, "human", "judge").agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The same counts with one column per judge verdict."""
    counts = [F.count_if(F.col("judge") == v).alias(f"judge_{v}") for v in VERDICTS]
    return comparable(pairs).groupBy(*by, "human").agg(*counts)


def disagreements(pairs: DataFrame) -> DataFrame:
    return comparable(pairs).where(F.col("human") != F.col("judge"))


def disagreement_report(
    pairs: DataFrame, answers: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Disagreements with question and answer texts, criterion then source order.

    Only rows that disagree are joined to the texts. A global sort first samples
    its input, so the few report rows are exchanged once before it; otherwise
    the scans and joins underneath would run twice.
    """
    report = disagreements(pairs).join(answers, keys)
    return report.repartition(*keys).orderBy("criterion", *order)


def first_disagreements(pairs: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` disagreements of every criterion."""
    return first_rows(disagreements(pairs), "criterion", [F.col(c) for c in order], n, out="rank")


def bias_alarm(
    pairs: DataFrame, by: list[str], min_rows: int, min_bias: float, max_opposite: float
) -> DataFrame:
    """Groups with a large bias that goes almost only one way, on enough rows."""
    up, down = F.col("more_generous"), F.col("harsher")
    opposite = F.when(F.col("bias") > 0, down).otherwise(up)
    return agreement(pairs, by).where(
        (F.col("n") >= min_rows)
        & (F.abs("bias") >= min_bias)
        & (F.try_divide(opposite, up + down) <= max_opposite)
    )


def sign_test(up: Column, down: Column) -> Column:
    """Two-sided exact sign test: how likely a split at least as uneven is if both ways are equally likely.

    ``2 * sum(C(n, i), i <= k) / 2^n`` with n = up + down and k the smaller one,
    1 at most, and 1 where n is 0. The largest term is taken in logarithms, the
    others relative to it; terms too small to matter for a double are not summed,
    so the work grows with the square root of n.
    """
    n = (up + down).cast("double")
    k = F.least(up, down).cast("double")
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0)
    # C(n, k - j) / C(n, k) for j = 1, 2, ...: each the one before times (k - j + 1) / (n - k + j)
    terms = F.least(k, F.ceil(7 * F.sqrt(n)) + 40).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ratio = lambda j: (k - j + 1) / (n - k + j)
    added = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), zero,
        lambda s, j: F.struct((s["term"] * ratio(j)).alias("term"), (s["total"] + s["term"] * ratio(j)).alias("total")),
        lambda s: s["total"])
    return F.least(F.lit(1.0), 2 * F.exp(first + F.log(added)))


def _log_factorial(n: Column) -> Column:
    """ln n!: a table up to 15, Stirling's series beyond, which is then exact to a double."""
    small = F.element_at(F.array(*(F.lit(math.lgamma(i + 1.0)) for i in range(16))), F.least(n, F.lit(15)).cast("int") + 1)
    series = (n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n)
              + 1 / (12 * n) - 1 / (360 * n ** 3) + 1 / (1260 * n ** 5) - 1 / (1680 * n ** 7))
    return F.when(n <= 15, small).otherwise(series)


def holm(tests: DataFrame, family: list[str], p_value: str, out: str = "p_adjusted") -> DataFrame:
    """p-values corrected for the number of tests of a family (Holm); a family is one row per test."""
    of = Window.partitionBy(*family)
    ordered = of.orderBy(p_value)
    scaled = F.col(p_value) * (F.count(F.lit(1)).over(of) - F.row_number().over(ordered) + 1)
    stepped = tests.withColumn(out, F.least(F.lit(1.0), scaled))
    so_far = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn(out, F.max(out).over(so_far))


def bias_alarm_tested(pairs: DataFrame, family: list[str], test: list[str], level: float = 0.05) -> DataFrame:
    """Bias of each test in its family with the p-value of the sign test, corrected over the family.

    ``alarm`` is raised where the corrected value is at most ``level``: the
    chance of any false alarm in a family is then at most that, whatever the
    number of its criteria. Rows are the disagreements' directions; equal verdicts do not count.
    """
    up, down = F.col("more_generous"), F.col("harsher")
    tested = agreement(pairs, [*family, *test]).withColumn("p_value", sign_test(up, down))
    return holm(tested, family, "p_value").withColumn("alarm", F.col("p_adjusted") <= level)

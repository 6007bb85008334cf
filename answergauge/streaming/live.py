"""Live gate monitor: pass rate per time window on a stream of judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.functions.verdicts import ERROR


def windowed_pass_rate(
    answers: DataFrame, ts: str, final_score: str, window: str, delay: str
) -> DataFrame:
    """Counts and pass rate per window; rows later than ``delay`` are dropped.

    The state is one counter pair per open window, whatever the traffic.
    """
    passed = F.col(final_score) == "pass"
    return (
        answers.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_pass"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "n", "n_pass", (F.col("n_pass") / F.col("n")).alias("pass_rate"))
    )


def corrected_pass_rate(
    answers: DataFrame, keys: list[str], ts: str, seen: str, final_score: str, window: str, delay: str
) -> DataFrame:
    """Counts and pass rate per window with each answer counted once, a retry in place of its ERROR.

    A retry is a further row with the answer's keys and its time ``ts``;
    ``seen`` orders the rows of an answer. As in ``retry_errors``, the first
    verdict that is not an ERROR stands, whatever comes after it. An answer is
    held until the watermark passes the end of its window, so ``delay`` is the
    time a retry may take; then its state is dropped and one row goes on to the
    counts. Both steps are aggregations of the engine: the state is one row per
    answer of the open windows, dealt by answer, and one counter per window.
    """
    failed = F.col(final_score) == ERROR
    settled = (
        answers.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), *keys)
        .agg(F.min_by(final_score, F.struct(failed, F.col(seen))).alias("_score"), F.count(F.lit(1)).alias("_rows"))
    )
    passed = F.col("_score") == "pass"
    return (
        settled.groupBy(F.window(F.window_time("w"), window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_pass"),
            F.count_if(F.col("_score") == ERROR).alias("n_errors"),
            F.count_if((F.col("_rows") > 1) & (F.col("_score") != ERROR)).alias("n_corrected"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "n", "n_pass", "n_errors", "n_corrected", (F.col("n_pass") / F.col("n")).alias("pass_rate"))
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, write closed windows to Parquet, and stop.

    Source offsets, state and the output log live in the checkpoint, so a lost
    executor or a restart neither loses nor repeats a window.
    """
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def monitor(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run the monitor once over the available input and read back its output."""
    run_available(stream, f"{folder}/windows", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/windows")

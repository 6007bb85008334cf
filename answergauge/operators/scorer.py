"""Bulk scoring through a caller-supplied function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergauge.functions.verdicts import ERROR


def bulk_score(
    df: DataFrame, keys: list[str], text: str, fn: Callable[[str], str], parallelism: int | None = None
) -> DataFrame:
    """Call ``fn(text)`` for every row; (keys, verdict, error, elapsed_ms).

    The function stands for a call to a service, so it is per row by nature.
    An exception marks its own row as ERROR and the rest goes on. Rows stream
    through in Arrow batches; ``parallelism`` spreads slow calls over more tasks
    than the scan has.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("verdict", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("elapsed_ms", T.DoubleType()),
        ])

    def call(value: str) -> tuple[str, str | None, float]:
        start = time.perf_counter()
        try:
            verdict, error = fn(value), None
        except Exception as e:  # any failure belongs to this row alone
            verdict, error = ERROR, str(e)
        return verdict, error, (time.perf_counter() - start) * 1000

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = pd.DataFrame(
                [call(v) for v in batch[text]], columns=["verdict", "error", "elapsed_ms"],
                index=batch.index)
            yield pd.concat([batch[keys], scored], axis=1)

    narrow = df.select(*keys, text)
    if parallelism:
        narrow = narrow.repartition(parallelism)
    return narrow.mapInPandas(score, schema)


def score_stream(
    answers: DataFrame, keys: list[str], text: str, fn: Callable[[str], str], folder: str,
    parallelism: int | None = None,
) -> DataFrame:
    """Score what has arrived in ``answers``, a stream, and return all scores so far.

    A job that dies goes on where it stopped when this is called again with the
    same ``folder``, a shared one: micro-batches that are finished are neither
    read nor scored again, and an unfinished one leaves no rows. A key that
    arrived before, in this run or an earlier one, is not scored again, wherever
    it stands in the input. How much an interruption can cost is one
    micro-batch, which the source's ``maxFilesPerTrigger`` sets.

    A row that ended in ERROR is tried again by sending it once more with the
    next number in a column ``attempt``, if ``keys`` names that column;
    ``latest_scores`` then takes the newest attempt of each answer. The keys
    seen are the stream's state, partitioned by key.
    """
    once = answers.dropDuplicates(keys)
    scored = bulk_score(once, keys, text, fn, parallelism)
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/scores").awaitTermination()
    return answers.sparkSession.read.schema(scored.schema).parquet(f"{folder}/scores")


def latest_scores(scores: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """One row per answer: that of its newest attempt."""
    rest = [c for c in scores.columns if c not in (*keys, attempt)]
    newest = scores.groupBy(*keys).agg(
        F.max(attempt).alias(attempt), F.max_by(F.struct(*rest), attempt).alias("_row"))
    return newest.select(*keys, attempt, "_row.*")


def next_attempts(scores: DataFrame, answers: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """The answers whose newest attempt is ERROR, numbered for another one: the input of a retry."""
    failed = latest_scores(scores, keys, attempt).where(F.col("verdict") == ERROR)
    again = failed.select(*keys, (F.col(attempt) + 1).alias(attempt))
    return answers.drop(attempt).join(again, keys)

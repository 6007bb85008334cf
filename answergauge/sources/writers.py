"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from answergauge.sources.readers import FULL_TIME


def write_csv(df: DataFrame, path: str, timestamp_format: str = FULL_TIME) -> None:
    """CSV with a header in every part file, quotes doubled, no blanks trimmed."""
    df.write.options(
        header="true", escape='"', timestampFormat=timestamp_format,
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, non-ASCII letters as they are."""
    df.write.json(path)


def write_run_sheets(df: DataFrame, folder: str, version: str, run: str = "run_id") -> None:
    """A new version folder per write, partitioned by run.

    Nothing is overwritten, so a job may read version n while it writes n+1.
    The rebalance hint sends a run to few tasks and lets adaptive execution
    split a run that is far larger than the others.
    """
    path = f"{folder}/version={version}"
    df.hint("rebalance", run).write.mode("errorifexists").partitionBy(run).parquet(path)

"""Scoring that goes on after a job died, and verdicts corrected on a stream."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest

from answergauge.functions.verdicts import ERROR
from answergauge.operators.gate import retry_errors
from answergauge.operators.scorer import bulk_score, latest_scores, next_attempts, score_stream
from answergauge.streaming.live import corrected_pass_rate, run_available

ANSWERS = "doc_id long, attempt int, text string"


def _stream(spark, folder):
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", "1").parquet(folder)


def _write(spark, folder, rows):
    spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(folder)


def test_a_job_killed_half_way_pays_for_no_answer_twice(spark, tmp_path):
    folder, out, calls, bomb = (str(tmp_path / n) for n in ("in", "out", "calls", "bomb"))
    for part in range(6):
        _write(spark, folder, [(part * 10 + i, 1, f"text {part * 10 + i}") for i in range(10)])
    _write(spark, folder, [(3, 1, "text 3"), (57, 1, "text 57"), (60, 1, "text 60")])  # delivered again

    def ask(text):
        with open(calls, "a") as log:
            log.write(text + "\n")
        if text == "text 25" and os.path.exists(bomb):
            os.kill(os.getpid(), 9)  # the worker dies, and the job with it
        return "good"

    open(bomb, "w").close()
    with pytest.raises(Exception):
        score_stream(_stream(spark, folder), ["doc_id", "attempt"], "text", ask, out)
    paid = Counter(open(calls).read().split("\n")[:-1])
    kept = {r.doc_id for r in spark.read.parquet(f"{out}/scores").collect()}
    assert len(kept) < 61
    os.remove(bomb)
    scores = score_stream(_stream(spark, folder), ["doc_id", "attempt"], "text", ask, out).collect()
    assert sorted(r.doc_id for r in scores) == list(range(61))
    again = Counter(open(calls).read().split("\n")[:-1])
    assert all(again[f"text {i}"] == paid[f"text {i}"] == 1 for i in kept)
    # nothing new: a third start scores nothing
    assert len(score_stream(_stream(spark, folder), ["doc_id", "attempt"], "text", ask, out).collect()) == 61
    assert sum(Counter(open(calls).read().split("\n")[:-1]).values()) == sum(again.values())


def test_errors_are_sent_again_as_further_attempts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def ask(text):
        if text.endswith("3") and not text.startswith("again"):
            raise ValueError("busy")
        return "ok"

    _write(spark, folder, [(i, 1, f"text {i}") for i in range(20)])
    scores = score_stream(_stream(spark, folder), ["doc_id", "attempt"], "text", ask, out)
    answers = spark.createDataFrame([(i, 0, f"again {i}") for i in range(20)], ANSWERS)
    retry = next_attempts(scores, answers, ["doc_id"]).select("doc_id", "attempt", "text")
    assert {(r.doc_id, r.attempt) for r in retry.collect()} == {(3, 2), (13, 2)}
    retry.write.mode("append").parquet(folder)
    scores = score_stream(_stream(spark, folder), ["doc_id", "attempt"], "text", ask, out)
    newest = latest_scores(scores, ["doc_id"]).collect()
    assert scores.count() == 22 and len(newest) == 20
    assert {r.verdict for r in newest} == {"ok"} and {r.doc_id for r in newest if r.attempt == 2} == {3, 13}


START = datetime(2024, 1, 1)
LIVE = "id long, ts timestamp, seen int, score string"


def _rows(*rows):
    return [(i, START + timedelta(minutes=m), s, score) for i, m, s, score in rows]


def test_a_streamed_rate_equals_the_batch_rate_after_the_retry(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def advance(rows):
        spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LIVE).parquet(folder)
        run_available(corrected_pass_rate(stream, ["id"], "ts", "seen", "score", "1 hour", "30 minutes"), out, checkpoint)
        return {r.window_start.hour: (r.n, r.n_pass, r.n_errors, r.n_corrected) for r in spark.read.parquet(out).collect()}

    first = _rows((1, 5, 1, "pass"), (2, 10, 1, ERROR), (3, 20, 1, ERROR), (4, 59, 1, "fail"), (5, 70, 1, ERROR))
    assert advance(first) == {}
    # 2 is corrected, 3 fails again, 4 was no error and keeps its verdict
    second = _rows((2, 10, 2, "pass"), (3, 20, 2, ERROR), (4, 59, 2, "pass"), (6, 85, 1, "pass"))
    assert advance(second) == {}
    third = _rows((5, 70, 2, "fail"), (7, 200, 1, "pass"))
    expected = {0: (4, 2, 1, 1), 1: (2, 1, 0, 1)}
    advance(third)
    assert advance(_rows((3, 20, 9, "pass"), (8, 400, 1, "pass"))) | expected == {**expected, 3: (1, 1, 0, 0)}  # 3 is too late

    sheet = spark.createDataFrame(first + _rows((6, 85, 1, "pass")), LIVE)
    retried = spark.createDataFrame([r for r in second + third if r[2] == 2 and r[3] != ERROR], LIVE)
    batch = retry_errors(sheet, retried, ["id"], ["score"], "score").groupBy("ts", "id", "score").count().collect()
    for hour, (n, n_pass, n_errors, _) in expected.items():
        own = [r.score for r in batch if r.ts.hour == hour]
        assert (len(own), own.count("pass"), own.count(ERROR)) == (n, n_pass, n_errors)


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    for hour in range(4):
        spark.createDataFrame(_rows(*((hour * 100 + i, hour * 60 + i % 60, 1, "pass") for i in range(100))), LIVE) \
            .coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", "1").parquet(folder)
    windows = corrected_pass_rate(stream, ["id"], "ts", "seen", "score", "1 hour", "10 minutes")
    query = windows.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    held = [max(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 200 and sum(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == 300


def test_the_same_scores_in_batch(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ANSWERS)
    assert {r.verdict for r in bulk_score(df, ["doc_id"], "text", str.upper).collect()} == {"A", "B"}

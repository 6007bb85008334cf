from datetime import datetime, timedelta

from answergauge.streaming.live import run_available, windowed_pass_rate

SCHEMA = "ts timestamp, score string"
START = datetime(2024, 1, 1)


def _write(spark, folder, rows):
    spark.createDataFrame([(START + timedelta(minutes=m), s) for m, s in rows], SCHEMA) \
        .coalesce(1).write.mode("append").parquet(folder)


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def advance():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        run_available(windowed_pass_rate(stream, "ts", "score", "1 hour", "10 minutes"), out, checkpoint)
        rows = spark.read.parquet(out).orderBy("window_start").collect()
        return [(r.window_start.hour, r.n, r.n_pass, r.pass_rate) for r in rows]

    _write(spark, folder, [(0, "pass"), (30, "fail"), (59, "pass"), (65, "pass")])
    assert advance() == []  # the watermark is at 0:55
    _write(spark, folder, [(20, "pass"), (75, "fail")])
    assert advance() == [(0, 4, 3, 0.75)]  # in time, counted; then 1:05 closes the window
    _write(spark, folder, [(10, "fail"), (200, "pass")])
    assert advance() == [(0, 4, 3, 0.75), (1, 2, 1, 0.5)]  # the late row changes nothing
    assert advance() == [(0, 4, 3, 0.75), (1, 2, 1, 0.5)]  # a restart repeats nothing


def test_same_expressions_in_batch(spark):
    df = spark.createDataFrame([(START, "pass"), (START, "ERROR")], SCHEMA)
    row = windowed_pass_rate(df, "ts", "score", "1 hour", "10 minutes").first()
    assert (row.n, row.n_pass, row.pass_rate) == (2, 1, 0.5)
    assert row.window_end - row.window_start == timedelta(hours=1)

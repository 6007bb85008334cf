import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from answergauge.session import shared_folder
from answergauge.sources import readers, writers


def test_samples_csv_round_trip(spark, tmp_path):
    rows = [
        ("S-10001", "Glucose", 70.0, "mg/dL", 70.0, 100.0, "Pass", 'ד. "כהן"', "A, B", datetime(2026, 1, 2, 5, 0), "B-1"),
        ("S-10002", "pH", 12.5, "pH", 6.8, 7.4, "OOS", None, " spaced ", datetime(2026, 7, 20, 15, 0), "B-2"),
    ]
    df = spark.createDataFrame(rows, readers.SAMPLES)
    writers.write_csv(df, str(tmp_path / "csv"), readers.LAB_TIME)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "csv/part-*")))
    assert '"ד. ""כהן"""' in text and "2026-01-02 05:00" in text
    back = readers.read_csv(spark, str(tmp_path / "csv"), readers.SAMPLES, readers.LAB_TIME)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_mixed_number_forms_and_bad_cells(spark, tmp_path):
    good = tmp_path / "ranges.csv"
    good.write_text("test_name,unit,reference_low,reference_high\nGlucose,mg/dL,70,100\nHb,g/dL,12.0,17.5\n")
    rows = readers.read_csv(spark, str(good), readers.RANGES).collect()
    assert [(r.reference_low, r.reference_high) for r in rows] == [(70.0, 100.0), (12.0, 17.5)]
    bad = tmp_path / "bad.csv"
    bad.write_text("test_name,unit,reference_low,reference_high\nGlucose,mg/dL,low,100\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(bad), readers.RANGES).collect()


def test_jsonl_keeps_letters(spark, tmp_path):
    df = spark.createDataFrame([("מה?\nline", "82.16 mg/dL", "S-10001", "value_lookup")], readers.QUESTIONS)
    writers.write_jsonl(df, str(tmp_path / "q"))
    line = "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "q/part-*.json")))
    assert "מה?" in line and json.loads(line)["question"] == "מה?\nline"
    assert readers.read_jsonl(spark, str(tmp_path / "q")).collect() == df.collect()


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.md").write_text("# א\nline\n\n## b\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("x", encoding="utf-8")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows) == ["# א\nline\n\n## b\n", "x"]
    assert all(r.path.endswith(".md") for r in rows)


def test_versioned_run_sheets(spark, tmp_path):
    folder = str(tmp_path / "sheets")
    sheet = spark.createDataFrame([("r1", 1, "good"), ("r2", 1, "bad"), ("r1", 2, None)], "run_id string, row_no int, v string")
    writers.write_run_sheets(sheet, folder, "1")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_run_sheets(sheet, folder, "1")
    # read version 1 while writing version 2
    first = readers.read_run_sheets(spark, folder, version="1")
    writers.write_run_sheets(first.withColumn("w", F.lit("new")), folder, "2")
    latest = readers.read_run_sheets(spark, folder)
    assert "w" in latest.columns and latest.count() == 3
    assert "w" not in first.columns and first.count() == 3
    single = readers.read_run_sheets(spark, folder, run_id="r1")
    assert single.count() == 2
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a.startswith(base) and a != b


def test_sheets_are_rebalanced_by_run(spark):
    sheet = spark.range(10).withColumn("run_id", F.lit("r"))
    plan = sheet.hint("rebalance", "run_id")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


class _Session:
    """Just enough of a session: its settings."""

    def __init__(self, **settings):
        self.conf = settings


def test_no_machine_local_folder_on_a_cluster():
    local = _Session(**{"spark.master": "local[2]", "spark.sql.warehouse.dir": "/data/warehouse"})
    assert shared_folder(local, "x").startswith("/data/warehouse/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session(**{"spark.master": "yarn"}), "x")
    cluster = _Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_folder(cluster, "x").startswith("hdfs:///shared/x-")


def test_csv_cells_with_line_breaks_and_seconds(spark, tmp_path):
    rows = [(1, "a\nb", datetime(2026, 1, 2, 3, 4, 55, 123456)), (2, None, None)]
    schema = "id int, note string, at timestamp"
    writers.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "csv"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "csv"), schema, multi_line=True).collect())) == rows


def test_run_ids_and_versions_come_back_as_written(spark, tmp_path):
    folder = str(tmp_path / "sheets")
    for version in ("01", "9", "10"):
        sheet = spark.createDataFrame([("007", version), ("7", version)], "run_id string, v string")
        writers.write_run_sheets(sheet, folder, version)
    rows = readers.read_run_sheets(spark, folder).collect()
    assert sorted((r.run_id, r.v) for r in rows) == [("007", "10"), ("7", "10")]
    assert readers.read_run_sheets(spark, folder, run_id="007", version="01").first().v == "01"

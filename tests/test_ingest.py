"""Rejects of typed scans, text files larger than a task, newest versions."""

import pytest
from pyspark.sql import functions as F

from answergauge.operators.textchecks import sections
from answergauge.sources import readers, writers

CSV = "id BIGINT, name STRING, at TIMESTAMP, v DOUBLE"
LINES = {
    "a.csv": ["id,name,at,v", "1,one,2024-01-02 03:04:05.000000,1.5", "x,two,2024-01-02 03:04:05.000000,2", "3,three", "4,\"a, \"\"b\"\"\",,",
              "5,five,yesterday,1", "", "6,six,2024-01-02 03:04:05.000000,1,7"],
    "b.csv": ["id,name,at,v", "7,seven,,abc", "8,,,8"]}


@pytest.fixture
def folder(tmp_path):
    for name, lines in LINES.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_csv_rejects_have_file_and_reason(spark, folder):
    read = readers.with_rejects(spark, folder, CSV)
    good = readers.good_rows(read)
    assert sorted(r.id for r in good.collect()) == [1, 4, 8] and good.columns == ["id", "name", "at", "v"]
    bad = {(r.file.rsplit("/", 1)[1], r.record): r.reason for r in readers.rejects(read).collect()}
    assert bad == {
        ("a.csv", LINES["a.csv"][2]): "id is not bigint", ("a.csv", "3,three"): "wrong number of cells",
        ("a.csv", LINES["a.csv"][5]): "at is not timestamp", ("a.csv", LINES["a.csv"][7]): "wrong number of cells",
        ("b.csv", "7,seven,,abc"): "v is not double"}
    # the split does not depend on the columns that are asked for
    assert good.select("name").count() == good.count() == 3 and readers.rejects(read).select("reason").count() == 5
    assert [r.name for r in good.where("id = 4").collect()] == ['a, "b"']


def test_json_rejects(spark, tmp_path):
    lines = ['{"id": 1, "name": "x"}', '{"id": "abc", "name": "y"}', "[1]", "{broken", '{"id": null}', '"text"', '{"id": 2, "more": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    read = readers.with_rejects(spark, str(tmp_path), "id BIGINT, name STRING", kind="json")
    assert {r.record: r.reason for r in readers.rejects(read).collect()} == {
        lines[1]: "id is not bigint", lines[2]: "no JSON object", lines[3]: "no JSON object", lines[5]: "no JSON object"}
    assert sorted(r.id or 0 for r in readers.good_rows(read).collect()) == [0, 1, 2]
    assert readers.good_rows(read).select("name").count() == 3


def test_no_files_with_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,at,v\n")
    read = readers.with_rejects(spark, str(tmp_path), CSV)
    assert readers.good_rows(read).count() == 0 and readers.rejects(read).count() == 0


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _corpus(n):
    out = ["before the first heading", "1. not yet"]
    for s in range(n):
        out.append(f"## Section {s}")
        if s % 3:
            out.append("lead ü of the section")
        for c in range(s % 5):
            out += [f"{c + 1}. clause {s}.{c} " + "words " * (s % 11), "", "  and its second line"][:1 + s % 3]
    return "\n".join(out)


def test_sections_across_byte_ranges_equal_the_whole_read(spark, tmp_path, small_ranges):
    for name, n in (("a", 700), ("b", 1), ("c", 40)):
        (tmp_path / f"{name}.md").write_text(_corpus(n) + "\n")
    lines = readers.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    got = readers.read_sections(spark, str(tmp_path), r"^## ", r"^\d+\. ").collect()
    whole = readers.read_documents(spark, str(tmp_path)).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    cut = sections(whole, ["path"], "text", r"(?m)(?:\n|\A)(?=## )", r"(?m)(?:\n|\A)(?=\d+\. )").where("clause <> '' OR section_no > 0")
    assert sorted((r.path, r.section_no, r.clause_no, r.text) for r in got) == sorted(
        (r.path, r.section_no, r.clause_no, r.clause) for r in cut.collect())
    assert len(got) > 1500


def test_newest_version_without_opening_files(spark, tmp_path):
    folder = str(tmp_path / "sheets")
    for version, value in (("2", "b"), ("10", "c"), ("07", "a")):
        writers.write_run_sheets(spark.createDataFrame([("r", value)], "run_id string, v string"), folder, version)
    for name in ("version=2", "version=07"):  # broken files of other versions do no harm
        for part in (tmp_path / "sheets" / name).rglob("*.parquet"):
            part.write_bytes(b"broken")
            part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.v for r in readers.read_run_sheets(spark, folder).collect()] == ["c"]

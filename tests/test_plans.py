"""What the plans must and must not contain, checked without broadcast joins."""

import os
import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry_point
from answergauge.plans import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")

ALL = entry_point.queries()
QUERIES = {name: ALL[name] for name in all_queries()}
WRITES = {
    "live_pass_rate", "csv_roundtrip", "jsonl_roundtrip", "run_sheet_versions", "sheet_agreement",
    "csv_timestamps", "whole_text_scan", "single_run_sheet", "retry_upsert", "latency_percentiles",
    "latency_percentiles_merged", "citation_search", "example_echo_phrases", "bulk_score_resumed",
    "live_corrected_rate", "csv_rejects", "large_file_sections"}
STREAMS = {"live_pass_rate", "live_corrected_rate", "bulk_score_resumed"}
PYTHON = {"bulk_score", "bulk_score_resumed"}
# windows without a partition over aggregated rows: one per run and criterion, one per leading digits of a hash
SMALL_WINDOWS = {"delta_vs_baseline", "large_sample"}


@pytest.fixture(scope="module")
def large(spark):
    """As on large tables: no join side is small enough to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plan(spark, large):
    """Physical plan text."""
    return lambda name: _text(QUERIES[name](spark, SF))


@pytest.fixture
def plans(spark, large, monkeypatch):
    """Physical plan texts of a query and of all that it writes on the way."""
    def collected(name):
        found = []
        for method in ("parquet", "csv", "json", "text"):
            def write(self, *args, _real=getattr(DataFrameWriter, method), **kw):
                found.append(_text(self._df))
                return _real(self, *args, **kw)

            monkeypatch.setattr(DataFrameWriter, method, write)
        last = _text(QUERIES[name](spark, SF))
        return [*found, last]

    return collected


def _check(name, text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BroadcastExchange" not in text
    if name not in PYTHON:
        assert not re.search("InPandas|PythonUDF|BatchEvalPython|InArrow", text)
    for spec in re.findall(r"Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", text):
        if name not in SMALL_WINDOWS:
            assert "ASC" in spec and not re.match(r"\s*\w+#\d+L? (ASC|DESC)", spec) or re.match(r"\s*\w+#\d+L?, ", spec), spec


@pytest.mark.parametrize("name", sorted(WRITES - STREAMS))
def test_queries_that_write_plan_alike(plans, name):
    found = plans(name)
    assert len(found) > 1
    for text in found:
        _check(name, text)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_operator_that_cannot_scale(plan, name):
    text = plan(name)
    _check(name, text)
    assert ("InPandas" in text) == (name == "bulk_score")


# citation checks and request texts need the text on both sides of their join
TEXT_JOINS = {
    "citation_check", "citation_counts", "run_records", "jsonl_roundtrip",
    # few texts are wanted, and only those are measured
    "subset_fill", "spot_check"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES - TEXT_JOINS))
def test_texts_stay_out_of_shuffles(plan, name):
    lines = plan(name).splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            below = next((x for x in lines[i + 1:] if "[" in x), "")
            columns = re.search(r"\[([^\]]*)\]", below)
            assert not columns or not re.search(r"(^|, )(text|html)#\d+(,|$)", columns.group(1)), below


@pytest.mark.parametrize("name", ["first_rows_per_run", "first_disagreements", "weekly_audit_sample"])
def test_top_rows_are_limited_before_the_shuffle(plan, name):
    text = plan(name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_samples_take_ordered(plan):
    assert "TakeOrderedAndProject" in plan("golden_sample")


def test_filters_reach_the_scan(plan):
    assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(event_type,error\)\)", plan("run_text_diff"))
    assert "ReadSchema: struct<value:double>" in plan("latency_bands")


def test_alignment_reuses_the_partitioning_of_its_inputs(plan):
    # two scans of each table, one exchange for each, none above the joins
    assert plan("run_text_diff").count("Exchange hashpartitioning") == 4

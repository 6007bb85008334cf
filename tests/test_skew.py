"""One id holds a third of all rows: its partition must be split, the result whole."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from answergauge.operators import replies as rp
from answergauge.operators import retrieve as rt
from answergauge.operators.runs import rating_drift

# Limits scaled down to the size of the test data; broadcasts off, as on large tables.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}
N = 60_000


@pytest.fixture
def small_limits(spark):
    @contextmanager
    def use():
        before = {k: spark.conf.get(k, None) for k in SMALL}
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    with use():
        yield


def _hot(column, hot, others):
    return F.when(F.col(column) % 3 == 0, hot).otherwise(F.pmod(F.hash(column), F.lit(others)))


def _final_plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[:text.index("Initial Plan")]


def test_hot_id_in_questions(spark, small_limits):
    questions = spark.range(N).select(
        F.col("id").alias("qid"),
        F.concat(F.lit("about S-"), (_hot("id", 7, 5000) + 10000).cast("string")).alias("question"))
    facts = spark.range(5000).select(
        F.concat(F.lit("S-"), (F.col("id") + 10000).cast("string")).alias("sid"),
        F.md5(F.col("id").cast("string")).alias("v"))
    context = rt.fact_context(
        rt.with_ids(questions, "question", r"S-\d{5}"), "qid", facts, "sid", ["sid", "v"])
    rows = context.collect()
    assert len(rows) == N and all(r.facts_csv for r in rows)
    assert "skew=true" in _final_plan(context)


def test_hot_document_in_citations(spark, small_limits):
    documents = spark.range(1000).select(
        F.col("id").alias("doc"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    replies = spark.range(N).select(
        "id", _hot("id", 7, 1000).cast("bigint").alias("doc")).select(
        "id", "doc", F.concat(F.lit("Reference: "), F.md5(F.col("doc").cast("string"))).alias("reply"))
    checked = rp.check_citations(replies, documents, "doc", "reply", "text")
    rows = checked.collect()
    assert len(rows) == N and {r.outcome for r in rows} == {"supported"}
    assert "skew=true" in _final_plan(checked)


def test_hot_text_is_reduced_before_the_shuffle(spark):
    df = spark.range(N).select(
        _hot("id", 1, 500).cast("string").alias("h"), F.lit("tone").alias("criterion"),
        F.when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("verdict"))
    drift = rating_drift(df, "h", ["criterion"])
    rows = {r.h: r.n for r in drift.collect()}
    assert sum(rows.values()) == N and rows["1"] > N / 3
    assert "HashAggregate" in drift._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in drift._jdf.queryExecution().executedPlan().toString()

"""The stages one after the other, each against its operator or a plain count."""

import os

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from answergauge.llm import latent_search, quality, simhash
from answergauge.sources.readers import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    (_, good), (_, lines), (_, one), (_, clean), (_, pack) = corpus_pipeline.STAGES

    first = good(spark, docs, SF).cache()
    marked = quality.classify(docs, read_table(spark, SF, "labels"))
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in marked.where("predicted = 1").collect()}

    second = lines(spark, first, SF).cache()
    seen = {}
    for r in first.orderBy("doc_id").collect():
        for line in r.text.split("\n"):
            seen.setdefault(line, r.doc_id)
    kept = [line for r in second.collect() for line in r.text.split("\n") if line]
    assert len(kept) == len(set(kept)) and set(kept) <= set(seen) and second.count() == first.count()
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = one(spark, second, SF).cache()
    groups = simhash.near_duplicates(second, shingle=4, max_bits=4)
    assert {r.doc_id for r in third.collect()} == {r.component_id for r in groups.collect()}

    fourth = clean(spark, third, SF).cache()
    leaks = latent_search.find_leaks(third, read_table(spark, SF, "benchmark"), paraphrased=latent_search.PARAPHRASED)
    assert {r.doc_id for r in third.collect()} - {r.doc_id for r in fourth.collect()} == {r.doc_id for r in leaks.collect()}
    assert leaks.count() > 0 and all(x.columns == columns for x in (first, second, third, fourth))

    pieces = pack(spark, fourth, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in fourth.collect()}
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in ran if p.doc_tokens == p.length) and \
        {(p.doc_id, p.doc_tokens) for p in ran} == {(p.doc_id, p.doc_tokens) for p in pieces}


def test_all_are_registered():
    names = entry_point.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_pipeline_on_edge_tables(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, and no rows at all go through every stage."""
    labels, benchmark = (read_table(spark, SF, t) for t in ("labels", "benchmark"))
    docs = read_table(spark, SF, "documents").limit(60)
    odd = spark.createDataFrame(
        [(None, "a text without an id", "en", "s", 20), (1_000_001, None, None, None, None), (1_000_002, "", "en", "s", 0)],
        docs.schema)
    tables = {"odd": docs.unionByName(odd).unionByName(odd), "none": docs.where("false")}
    for name, table in tables.items():
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert (len(pieces) > 0) == (name == "odd")
        assert sum(p.start == 0 for p in pieces) <= table.count()

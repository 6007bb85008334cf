"""Paraphrases with half to four fifths of an item's words, with the end kept or reworded, against brute force."""

import random

import pytest

import corpus_pipeline
from answergauge.llm import queries
from test_filters import _lcs


@pytest.fixture(scope="module")
def reworded():
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    usual = ["the", "of", "and", "to"]

    def prose(n):
        return [rng.choice(usual) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: prose(rng.randint(16, 60)) for i in range(40)}
    docs, planted = [], {}
    for d in range(400):
        item, end_kept = rng.randrange(40), d % 2 == 0
        own = items[item]
        n = len(own)
        answer = set(range(3)) | (set(range(n - 3, n)) if end_kept else set())  # both answers, or the one at the start
        spare = [k for k in range(n) if k not in answer and (end_kept or k < n - 3)]
        rng.shuffle(spare)
        share = rng.uniform(0.5, 0.8)
        same = answer | set(spare[:max(0, -int(-share * n // 1) - len(answer))])
        part = []
        for k in range(n):
            part += [own[k]] if k in same else [rng.choice(vocabulary)]
        text, at = prose(rng.choice([5, 60, 400])), 3
        docs.append((d, " ".join(text[:at] + part + text[at:])))
        if 0.5 <= _lcs(own, part) / n < 0.8:
            planted[d, item] = end_kept
    return docs, items, planted


def test_paraphrases_are_found(spark, monkeypatch, reworded):
    docs, items, planted = reworded
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(i, " ".join(w), " ".join(w[:3])) for i, w in items.items()]
    with_answer = spark.createDataFrame(rows, "item_id long, text string, answer string")
    for benchmark, wanted in ((with_answer, set(planted)), (with_answer.drop("answer"), {k for k, kept in planted.items() if kept})):
        tables = {"documents": df, "benchmark": benchmark}
        monkeypatch.setattr(queries, "read_table", lambda spark, sf, name: tables[name])
        monkeypatch.setattr(corpus_pipeline, "read_table", lambda spark, sf, name: tables[name])
        got = {(r.doc_id, r.item_id): r for r in queries.op4_latent_search(spark, "").collect()}
        low = {k for k in wanted if k in got and got[k].share < 0.6}
        print(f"{len(wanted & set(got))} of {len(wanted)} found, {len(low)} of them under 0.6;"
              f" ends reworded: {sum(not planted[k] for k in wanted & set(got))} of {sum(not planted[k] for k in wanted)}")
        assert low
        assert all(r.share >= 0.8 or r.share >= 0.5 and r.answer for r in got.values())
        assert len(wanted & set(got)) >= 0.95 * len(wanted)
        (stage,) = [f for name, f in corpus_pipeline.STAGES if name == "decontamination"]
        assert {r.doc_id for r in stage(spark, df, "").collect()} == {d for d, _ in docs} - {d for d, _ in got}

"""Lines under the usual bound are kept once as well."""

import random

import corpus_pipeline
from answergauge.llm import edit_join, queries
from test_duplicates import _changed, levenshtein, union


def _allowed(a, b):
    n = min(len(a), len(b))
    return 2 if n >= 20 else 1 if n >= 10 else 0


def test_short_lines_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([3, 8, 9, 10, 11, 15, 18, 19, 20, 21, 30]))) for _ in range(25)]
    docs = [(i, "\n".join([*(_changed(rng, rng.choice(bases), rng.randint(0, 2)) for _ in range(rng.randint(0, 5))), "", "Les."]))
            for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = {(i, k): line for i, t in docs for k, line in enumerate(t.split("\n"))}
    different = sorted(set(lines.values()))
    links = [(a, b) for x, a in enumerate(different) for b in different[x + 1:] if levenshtein(a, b) <= _allowed(a, b)]
    assert sum(min(map(len, pair)) < 20 for pair in links) > 20
    low, first = union(different, links), {}
    for place in sorted(lines):
        first.setdefault(low[lines[place]], place)
    monkeypatch.setattr(queries, "read_table", lambda *_: df)
    rows = queries.op1_edit_join(spark, "").collect()
    assert len(rows) == len(lines)
    for r in rows:
        line = lines[r.doc_id, r.line_no]
        assert r.n_links == sum(line in pair for pair in links)
        assert r.kept == (not line or (r.doc_id, r.line_no) == first[low[line]])
    (stage,) = [f for name, f in corpus_pipeline.STAGES if name == "line_dedup"]
    kept = {r.doc_id: r.text for r in stage(spark, df, "").collect()}
    for i, t in docs:
        assert kept[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if not x or (i, k) == first[low[x]])


def test_short_lines_on_edges(edge_docs, no_docs):
    assert edit_join.join_lines(no_docs, short_lines=True).count() == 0
    assert edit_join.dedup_lines(edge_docs, short_lines=True).count() == 11

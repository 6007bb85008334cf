"""Fill-in-the-middle texts: exact round trips and cuts."""

import random
from collections import Counter
from hashlib import sha256

import pytest

from answergauge.llm import fill_middle as fim


def test_ends_of_units():
    assert fim.unit_ends("") == [] and fim.unit_ends("a\n😀é") == [1, 2, 3, 4]
    assert fim.unit_ends("ab cd  e", r"\S+\s*|\s+") == [3, 7, 8]
    with pytest.raises(ValueError):
        fim.unit_ends("ab1", "[a-z]")


def test_marks_at_every_border_round_trip():
    """Texts of nothing but pieces of marks: no cut makes a mark that is read for another."""
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("<>PSM") for _ in range(rng.randint(1, 12)))
        if any(m in text for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
            continue
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        for form in ("psm", "spm"):
            assert fim.restore(fim.write(text, form, a, b), form) == text


def test_documents_against_slices(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n😀é") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["x<M>y", "<P", None]
    rows = {r.doc_id: r for r in fim.fill_middle(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, r = t or "", rows[i]
        digest = sha256(f"1:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        plain = t == "" or "<M>" in t or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output) == (len(t), form, output)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (a, b - a))
        assert r.output_sha256 == sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == sha256(t.encode()).hexdigest()
    forms = Counter(r.form for r in rows.values())
    assert 0.05 < forms["plain"] / len(rows) < 0.17 and 0.1 < forms["spm"] / len(rows) < 0.27


def test_words_as_units(spark):
    docs = spark.createDataFrame([(i, "one two  three four five") for i in range(20)], "doc_id long, text string")
    rows = fim.fill_middle(docs, unit=r"\S+\s*").collect()
    borders = {0, 4, 9, 15, 20, 24}
    assert {r.n for r in rows} == {5}
    assert all(r.form == "plain" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= borders for r in rows)


def test_edge_tables(edge_docs, no_docs):
    rows = fim.fill_middle(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.form == "plain" and r.output == "" for r in rows if r.n == 0)
    assert all(sha256(r.output.encode()).hexdigest() == r.output_sha256 for r in rows)
    assert fim.fill_middle(no_docs, with_text=False).count() == 0

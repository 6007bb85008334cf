"""Benchmark search, quality classifier and pseudonyms."""

import hashlib
import os
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from answergauge.llm import latent_search, pii, quality
from answergauge.sources.readers import read_table

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.fixture(scope="module")
def leaky(spark):
    """Texts of random words, some with an item: whole, with changed words, shuffled or only partly."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    usual = ["the", "of", "and", "to"]

    def prose(n):
        return [rng.choice(usual) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: prose(rng.randint(12, 60)) for i in range(40)}
    items[40] = prose(4)
    docs, planted, answered = [], set(), set()
    for d in range(400):
        text, item = prose(rng.choice([5, 60, 400])), rng.randrange(41)
        part, at = list(items[item]), rng.randrange(len(text))
        kind = rng.choice(["none", "whole", "changed", "shuffled", "part"])
        if kind == "none":
            part = []
        elif kind == "changed":  # a sixth of the words replaced or dropped, the end kept
            part = [w for k, w in enumerate(part) if k % 6 or k >= len(part) - 3]
            if item != 40:
                planted.add((d, item))
        elif kind == "shuffled":
            rng.shuffle(part)
        elif kind == "part":
            part = part[:len(part) // 3]
        else:
            planted.add((d, item))
        docs.append((d, " ".join(text[:at] + part + text[at:]).title()))
    return docs, [(i, ", ".join(w)) for i, w in items.items()], planted


def test_search_against_brute_force(spark, leaky):
    docs, items, planted = leaky
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([*items, (98, None), (99, " ")], "item_id long, text string")
    found = latent_search.find_leaks(df, benchmark).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    texts, own = dict(docs), {i: latent_search.words(t) for i, t in items}
    missed = planted - set(got)
    assert len(missed) <= 0.02 * len(planted)  # the latent space is an index; recall is measured
    for (d, i), r in got.items():
        part = latent_search.words(texts[d])[r.start_word:r.start_word + r.n_words]
        assert r.lcs == _lcs(own[i], part) and r.share == r.lcs / len(own[i])
        assert r.share >= 0.8 or r.share >= 0.6 and r.answer
    clean = {r.doc_id for r in latent_search.drop_leaked(df, benchmark).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert not {(d, i) for d, i in got if (d, i) not in planted and got[d, i].share < 0.6}


def test_benchmark_in_blocks_and_answers(spark, monkeypatch, leaky):
    docs, items, _ = leaky
    df = spark.createDataFrame(docs[:120], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in latent_search.find_leaks(df, benchmark).collect() if r.share >= 0.8}
    monkeypatch.setattr(latent_search, "BLOCK_WORDS", 300)
    parts = {(r.doc_id, r.item_id) for r in latent_search.find_leaks(df, benchmark).collect() if r.share >= 0.8}
    assert len(whole ^ parts) <= 0.05 * len(whole)
    other = benchmark.withColumn("answer", F.lit("never written anywhere"))
    assert all(r.share >= 0.8 and not r.answer for r in latent_search.find_leaks(df, other).collect())


def test_search_on_edges(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "the very same text stands here twice over"), (None, "a text without an id, long enough to be a line")],
                                      "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in latent_search.find_leaks(edge_docs, benchmark).collect()), key=repr)
    assert got == [(6, 1), (6, 1), (7, 1), (None, None)]
    assert latent_search.find_leaks(no_docs, benchmark).count() == 0
    assert latent_search.find_leaks(edge_docs, benchmark.where("false")).count() == 0
    kept = latent_search.drop_leaked(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.count() == 7


@tables
def test_quality_on_the_held_out_fold(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # labels of the held-out fold do not matter
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.where("doc_id < 50")
    assert sorted(quality.classify(few, labels).collect()) == sorted(quality.classify(few, turned).collect())


def test_quality_on_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1), (8, 0)], "doc_id long, quality int")
    assert len(quality.classify(edge_docs, labels).collect()) == 11
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(edge_docs, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(edge_docs, labels.where("false")).columns == edge_docs.columns
    assert quality.keep_good(edge_docs, labels.where("false")).count() == 11


def _feistel(left, right, a, b, tag, key="k"):
    for i in range(pii.ROUNDS):
        word = hashlib.md5(f"{key}|{tag}|{i}|{right}".encode()).hexdigest()
        size = b if i % 2 else a
        left, right = right, (left + int(word[:15], 16)) % size
    return left, right


def _digits(d, tag):
    h = len(d) // 2
    left, right = _feistel(int(d[:h]), int(d[h:]), 10 ** h, 10 ** (len(d) - h), f"{tag}{len(d)}")
    return f"{left:0{h}d}{right:0{len(d) - h}d}"


def _check(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        v = int(c) * (1 if k % 2 else 2)
        total += v // 10 + v % 10
    return str(-total % 10)


def _card(m):
    body = _digits(re.sub("[^0-9]", "", m)[:-1], "card")
    new = iter(body + _check(body))
    return "".join(next(new) if c.isdigit() else c for c in m)


def _phone(m):
    d = re.sub("[^0-9]", "", m)
    new = iter(d[:-10] + _digits(d[-10:], "phone"))
    return "".join(next(new) if c.isdigit() else c for c in m)


def _address(m):
    o = [int(x) for x in m.split(".")]
    return ".".join(str(v) for x in _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address") for v in divmod(x, 256))


def _date(m, form="%Y-%m-%d"):
    first = date(1600, 1, 1)
    a, b = pii.DAYS
    n = (date.fromisoformat(m) - first).days
    left, right = _feistel(n // b, n % b, a, b, "date")
    return str(first + timedelta(days=left * b + right))


def _social(m):
    a, g, s = (int(x) for x in m.split("-"))
    left, right = _feistel(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "social")
    return f"{left + 1 + (left >= 665):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def _random_values(rng, n):
    for _ in range(n):
        body = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 18)))
        yield "card", body + _check(body), _card
        yield "phone", f"+{rng.randint(1, 99)} ({rng.randint(0, 999):03d}) {rng.randint(0, 999):03d}-{rng.randint(0, 9999):04d}", _phone
        yield "address", ".".join(str(rng.randint(0, 255)) for _ in range(4)), _address
        yield "date", str(date(1600, 1, 1) + timedelta(days=rng.randrange(292194))), _date
        yield "social", f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", _social


def test_pseudonyms_against_plain_python(spark):
    values = list(_random_values(random.Random(3), 40))
    docs = [(i, f"x {v}, y {v}\nend {v}") for i, (_, v, _) in enumerate(values)]
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    for i, (kind, v, expected) in enumerate(values):
        new = expected(v)
        assert rows[i].text == f"x {new}, y {new}\nend {new}", (kind, v)
        assert rows[i][f"n_{kind}"] == rows[i].n_replaced == 3


def test_what_is_and_is_not_replaced(spark):
    texts = {
        1: "4111 1111 1111 1111 and 4111-1111-1111-1112", 2: "999.1.1.1, 1.2.3.4.5, version 4.0 and 10.0.0.1.",
        3: "2023-02-29, 31/12/2020, 12/31/2020, 01.02.1999, 0001-01-01", 4: "jo.Doe-7@mail.example.com.", 5: 'token = "Ab3dEf6h1jKl2nOp"',
        6: "000-12-3456 666-12-3456 123-00-1234 123-45-6789", 7: "12345", 8: "5$1 \\1 4111111111111111"}
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "k").collect()}
    assert rows[1].n_card == 1 and rows[1].text.endswith("and 4111-1111-1111-1112")
    shape = re.fullmatch(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) and .*", rows[1].text)
    number = "".join(shape.groups())
    assert number != "4111111111111111" and _check(number[:-1]) == number[-1]
    assert rows[2].text.startswith("999.1.1.1, 1.2.3.4.5, version 4.0 and ") and rows[2].n_address == 1
    assert rows[3].n_date == 3 and rows[3].text.startswith("2023-02-29, ") and rows[3].text.endswith(", 0001-01-01")
    assert re.fullmatch(r"[a-z]{2}\.[A-Z][a-z]{2}-\d@mail\.example\.com\.", rows[4].text) and rows[4].text != texts[4]
    assert rows[5].n_secret == 1 and rows[5].text != texts[5] and len(rows[5].text) == len(texts[5])
    assert rows[6].n_social == 1 and rows[6].text.startswith("000-12-3456 666-12-3456 123-00-1234 ")
    assert rows[7].text == "12345" and not rows[7].changed
    assert rows[8].n_card == 1 and rows[8].text.startswith("5$1 \\1 ")


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymise(days, "k")
    assert out.select("text").distinct().count() == 3000
    assert out.where(F.try_to_timestamp("text", F.lit("yyyy-MM-dd")).isNull()).count() == 0
    other = pii.pseudonymise(days, "another key").join(out.withColumnRenamed("text", "t"), "doc_id")
    assert other.where("text = t").count() < 5


def test_slashed_dates_never_share_a_pseudonym(spark):
    """Every string that is a date of 1600 to 2399 with the day or, where that is none, the month first."""
    days = spark.range(292194).select(F.date_add(F.lit("1600-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.date_format("d", "dd/MM/yyyy").alias("text")).unionByName(
        days.where("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("text")))
    out = pii.pseudonymise(texts.withColumn("doc_id", F.lit(1)), "k")
    month_first = F.try_to_timestamp("text", F.lit("dd/MM/yyyy")).isNull()
    found = out.agg(F.count("*"), F.countDistinct("text"), F.sum("n_date"), F.count_if(month_first),
                    F.count_if(F.try_to_timestamp("text", F.lit("MM/dd/yyyy")).isNull() & month_first)).first()
    assert tuple(found) == (292194 + 176994,) * 3 + (176994, 0)


def test_pseudonyms_on_edges(edge_docs, no_docs):
    assert pii.pseudonymise(no_docs, "k").count() == 0
    rows = pii.pseudonymise(edge_docs, "k").collect()
    assert len(rows) == 11 and not any(r.changed for r in rows)
    assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]


def test_pseudonyms_stay_in_the_jvm(edge_docs):
    plan = pii.pseudonymise(edge_docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

import random

from answergauge.operators.quotes import _among, _places, find_quotes
from answergauge.operators.replies import check_citations, search_citations
from answergauge.operators.textchecks import phrase_echo
from answergauge.session import written


def _store(df):
    return written(df, "test")


def _found(spark, quotes, texts):
    q = spark.createDataFrame([(x,) for x in quotes], "quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = find_quotes(q, "quote", t, "id", "text", _store).collect()
    assert len(rows) == len(set(rows))
    return {(r.quote, r.id) for r in rows}


def _all_pairs(quotes, texts):
    return {(q, i) for q in quotes if q and q.strip() for i, t in enumerate(texts) if t is not None and q in t}




def test_equal_to_all_pairs(spark):
    rng = random.Random(7)
    words = ["the", "a", "cat", "catalog", "hé", "x.", "(b)", "Zug", "😀", "ab" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).replace("cat a", "cat\na") for _ in range(120)]
    texts += [None, "", " ", "the  double space", "tail of a word"]
    quotes = ["the cat a", "at the ca", "cat", "a", "é", "cat the", "og  the", "nowhere to be seen", "the nowhere cat", "x. (b)",
              "", " ", None, "😀", "😀 Zug", "ababab", "the the the the", "double space", "  double", "f a w", "il of a wo"]
    for text in texts[:40]:
        if len(text) > 12:
            at = rng.randint(0, len(text) - 10)
            quotes.append(text[at:at + rng.randint(1, 40)])
    assert _found(spark, quotes + quotes[:5], texts) == _all_pairs(quotes, texts)


def test_empty_tables(spark):
    assert _found(spark, [""], ["some text"]) == set()
    t = spark.createDataFrame([], "id long, text string")
    q = spark.createDataFrame([("a b c",), ("x",)], "quote string")
    assert find_quotes(q, "quote", t, "id", "text", _store).count() == 0


def test_texts_meet_only_their_candidates(spark):
    """No product of quotes and texts, and the texts are joined on their id alone."""
    q = spark.createDataFrame([("one two three",)], "quote string")
    t = spark.createDataFrame([(i, "one two three") for i in range(5)], "id long, text string")
    plan = find_quotes(q, "quote", t, "id", "text", _store)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_candidates_do_not_grow_with_common_words(spark):
    """Every word of the quotes stands in every text; their pairs stand in few."""
    words = [f"w{k}" for k in range(30)]
    rng = random.Random(3)
    texts = [" ".join(rng.sample(words, 30)) for _ in range(200)]
    quotes = sorted({" ".join(t.split()[-n:]) for t in texts for n in (4, 5, 8)} | {"2 w3 w", "w5 w6 w7"})
    sizes = []

    def store(df):
        out = _store(df)
        sizes.append((out.columns, out.count()))
        return out

    q = spark.createDataFrame([(x,) for x in quotes], "quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.quote, r.id) for r in find_quotes(q, "quote", t, "id", "text", store).collect()}
    assert got == _all_pairs(quotes, texts)
    assert sizes[-1][0] == ["_quote", "_id"] and sizes[-1][1] <= 10 * len(quotes)


def test_places_that_no_quote_needs_stay_in_the_scan(spark):
    """Stored keys carry no quotes, and few of the places in texts reach a shuffle."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400)) for _ in range(100)]
    quotes = [" ".join(t.split()[-9:]) for t in texts]
    q = spark.createDataFrame([(x,) for x in quotes], "quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stored = []

    def store(df):
        out = _store(df)
        stored.append((out.columns, out.count()))
        return out

    assert {(r.quote, r.id) for r in find_quotes(q, "quote", t, "id", "text", store).collect()} == set(zip(quotes, range(100)))
    assert (["_needle", "_key"], 600) in stored and not any("_quote" in c and "_key" in c for c, _ in stored)
    places = _places(t.selectExpr("id AS _id", "split(text, ' ') AS _words"), 2)
    keys = _store(places.limit(600).select("_key"))
    passed = _among(places, keys)
    assert passed.join(keys.distinct(), "_key").count() == places.join(keys.distinct(), "_key").count() >= 600
    assert places.count() == 39_700 and passed.count() < 2000


def test_repeated_phrases_of_a_text_are_one_place(spark):
    t = spark.createDataFrame([(1, ["a", "b", "c", "d"] * 5), (2, ["a", "b"]), (3, []), (1, ["a", "b", "c", "d"])],
                              "_id long, _words array<string>")
    assert sorted(r._id for r in _places(t, 2).collect()) == [1] * 5
    assert sorted(r._id for r in _places(t, 1).collect()) == [1] * 6


def test_citations_without_a_known_document(spark):
    replies = [(1, 9, "So it is.\nReference: grey stones"), (2, 9, "Reference: no such words at all"),
               (3, 9, "I can't find that in the document."), (4, 9, "no quote"), (5, 8, "Reference: grey stones ")]
    replies = spark.createDataFrame(replies, "row_no long, doc_id long, reply string")
    docs = spark.createDataFrame([(7, "many grey stones lie"), (8, "grey stones"), (9, "nothing")], "doc_id long, text string")
    got = search_citations(replies, docs, "doc_id", "reply", "text", _store).collect()
    assert {(r.row_no, r.found_in, r.first_doc) for r in got} == {(1, 2, 7), (2, 0, None), (5, 2, 7)}
    checked = check_citations(replies, docs, "doc_id", "reply", "text").collect()
    assert {r.row_no: r.outcome for r in checked} == {
        1: "unsupported", 2: "unsupported", 3: "refused", 4: "no_citation", 5: "supported"}


def test_phrases(spark):
    answers = spark.createDataFrame([(1, "value 95.40 mg/dL today"), (2, "fine"), (3, "95.40 mg/dL and 70.0-100.0")], "id long, text string")
    phrases = spark.createDataFrame([("95.40 mg/dL",), ("70.0-100.0",), ("95.40 mg/dL",)], "phrase string")
    got = phrase_echo(answers, "id", "text", phrases, "phrase", _store).collect()
    assert {(r.id, r.echoed, r.first_echo) for r in got} == {(1, 1, "95.40 mg/dL"), (3, 2, "70.0-100.0")}

"""Wrapper induction: trees, alignment against brute force, and pages with a known main text."""

import json
import random
from functools import reduce
from itertools import combinations

import pytest

from answergauge.llm import dom, wrapper
from answergauge.llm.wrapper import extract

PROSE = ["Rivers carry stones a long way.", "Nobody had counted the lamps & chairs.", "Später kam der Regen.", "A third, \"quoted\" line."]


def _article(i, n=3):
    rng = random.Random(i)
    return [f"Title {i}"] + [f"{rng.choice(PROSE)} Number {i}-{k}." for k in range(n)]


def _inside(lines):
    from html import escape

    return f"<h1>{escape(lines[0])}</h1>" + "".join(f"<p>{escape(x)}</p>" for x in lines[1:])


def test_trees_of_broken_html():
    blocks = lambda h: dom.blocks(dom.parse(h), lambda e: False)
    assert blocks("<p><b>one<br><p>two  \n three</p>tail") == ["one", "two three", "tail"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>x<td>y<tr><td>z</table>") == list("abcxyz")
    assert blocks("<script>var t='<p>no</p>'</script>a<style>p{}</style><!-- <p>no -->b<!-- open") == ["ab"]
    assert blocks("1 < 2 &amp &lt;b&gt; &#x41;&nbsp;&eacute; <3 <a href='x>y'>l</a>") == ["1 < 2 & <b> A é <3 l"]
    assert blocks("<b><div></b>in</div>out</div></span>") == ["in", "out"]
    assert blocks("text<a href=\"never closed") == ["text"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("</>x<!>y<?z?>") == ["xy"]
    assert blocks("<div>" * 5000 + "deep" + "</div>" * 5000 + "after") == ["deep", "after"]
    assert dom.parse("<div id='post-12' class='b a9'>x").elements()[0].label == "div.post-#.a#.b"


def _brute(a, b):
    """Largest order-preserving matching of two sequences of groups, by trying all."""
    best = 0
    for size in range(min(len(a), len(b)) + 1):
        for x in combinations(range(len(a)), size):
            for y in combinations(range(len(b)), size):
                total = 0
                for i, j in zip(x, y):
                    common = a[i].keys() & b[j].keys()
                    total += sum(1 + _brute(a[i][k]["c"], b[j][k]["c"]) for k in common)
                best = max(best, total)
    return best


def _random_html(rng, depth=0):
    if depth == 3:
        return "x"
    return "".join(f"<div class={rng.choice('abcd')}>{_random_html(rng, depth + 1)}</div>" for _ in range(rng.randint(0, 4))) + "t"


def test_alignment_is_simple_tree_matching():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (wrapper.sketch_of(_random_html(rng)) for _ in range(2))
        size, pairs = wrapper.match(a["c"], b["c"])
        assert size == _brute(a["c"], b["c"])
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_merging_keeps_every_label_once_and_counts_in_any_order():
    rng = random.Random(2)
    trees = [wrapper.sketch_of(_random_html(rng)) for _ in range(40)]

    def counts(node, path=()):
        labels = [label for group in node["c"] for label in group]
        assert len(labels) == len(set(labels))
        out = {path: node["n"]}
        for group in node["c"]:
            for label, below in group.items():
                out.update(counts(below, (*path, label)))
        return out

    copies = [json.dumps(t) for t in trees]
    whole = counts(reduce(wrapper.merge, map(json.loads, copies)))
    rng.shuffle(copies)
    halves = [reduce(wrapper.merge, map(json.loads, part)) for part in (copies[:13], copies[13:])]
    assert counts(wrapper.merge(*halves)) == whole


TEMPLATES = {
    "article": "<html><head><title>{i}</title></head><body><nav><a href=/>Home {i}</a></nav><article>{a}</article>"
               "<aside>Other {i}</aside><div class=cookie-notice>We use cookies {i}</div><footer>&copy; {i}</footer></body></html>",
    "main": "<body><div role=banner>Site {i}</div><main>{a}<form><label>mail {i}</label><input></form>"
            "<section id=comments><h2>Comments</h2><article class=comment><p>Nice {i}</p></article></section></main></body>",
    # nothing says what is what but the other pages
    "plain": "<body><div class=top>The Daily Page <a href=/>front</a></div><div class=x1>{a}</div>"
             "<div class=x2>Read on {j}, call 555, and do not forget to write.</div>"
             "<ul><li><a href=/{i}>more {i}</a></li><li><a href=/{i}b>more {i}b</a></li></ul><p class=end>All rights held by us.</p></body>",
    "inner": "<body><article><div class=q>Print this page now</div>{a}<div class=z>Sent from our office</div></article></body>",
}


@pytest.mark.parametrize("kind", TEMPLATES)
def test_hosts_with_templates(spark, kind):
    made = {i: _article(i, 1 + i % 5) for i in range(12)}
    rows = [(i, f"http://{kind}.example.org/{i}", TEMPLATES[kind].format(i=i, j=7, a=_inside(lines))) for i, lines in made.items()]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n".join(lines) for i, lines in made.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_copies_are_not_taken_for_template(spark):
    copy = f"<body><div class=w>{_inside(_article(1))}</div></body>"
    rows = [(i, "http://copies.example.org/a", copy) for i in range(6)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"\n".join(_article(1))} and len(got) == 6


def test_a_hot_host_in_many_groups_equals_one(spark, monkeypatch):
    """The blocks, and blocks of blocks, find what aligning all pages at once finds."""
    html = {i: TEMPLATES["plain" if i % 3 else "inner"].format(i=i, j=7, a=_inside(_article(i, 1 + i % 4))) for i in range(150)}
    rows = [(i, f"//{'hot' if i < 120 else f'h{i % 7}'}.example.org/{i}", h) for i, h in html.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(wrapper, "GROUP", 4)
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        pages = {i: h for i, u, h in rows if u.split("/")[2] == host}
        assert len(set(pages.values())) == len(pages)
        whole = reduce(wrapper.merge, (wrapper.sketch_of(h) for h in pages.values()))
        known = whole if wrapper.has_template(whole) else None
        assert {i: got[i] for i in pages} == {i: extract(h, known) for i, h in pages.items()}


def test_edge_tables(spark):
    long = "<p>" + "very long text " * 20000
    rows = [(None, None, None, "x"), (1, "http://a.example/", "", "x"), (2, "not a url", "just text", "x"),
            (2, "not a url", "just text", "x"), (3, "http://A.example:80/x", long, "x"), (4, "", "<nav>menu</nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr(
        "*", "1 AS wrapper", "2 AS deal", "3 AS tree")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in wrapper.main_text(df).collect())
    words = " ".join(["very long text"] * 20000)
    assert got == [("1", "", 0), ("2", "just text", 9), ("2", "just text", 9), ("3", words, len(words)), ("4", "", 0), ("None", "", 0)]
    assert wrapper.main_text(df.where("false")).count() == 0

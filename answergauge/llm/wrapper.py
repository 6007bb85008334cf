"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page's element tree is folded (siblings
between the first and the last of one label form one iterated group, so a long
list is as large as one item), and the folded trees of a host are aligned by
simple tree matching: the order-preserving match of children that covers most
nodes, found by dynamic programming level by level. Matched nodes merge, so a
host has one tree, its wrapper, however many pages it has. A node of the wrapper
counts its texts. A node whose text is the same on nearly all pages is template;
the others are slots, and what stands in slots is content, unless the slot says
by tag, role or class what else it is: a menu, a header, an advert, a comment.

How it runs: the scan reduces a page to its folded tree, a few hundred bytes.
Pages of a host are dealt to groups of a bounded number, each group is aligned
in one task, and groups of wrappers are aligned in turn until a host has one: no
host, however hot, is gathered, and no html is shuffled for it. The last pass
reads the pages next to their hosts' wrappers, which Spark broadcasts if few.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm import dom
from answergauge.llm.base import stored

GROUP = 256  # pages, or wrappers, aligned by one task at a time
CONSTANT, LEAST_PAGES = 0.8, 4  # share and number of a host's pages that make a text template
# A node counts at most TEXTS texts, a heavy-hitter summary, and a page with over ITERATED texts at one place counts
# none there: a count is short by at most ITERATED / (TEXTS + 1) of the pages.
TEXTS, ITERATED = 16, 2
# A wrapper of over WIDE nodes forgets those that fewer than one in RARE of its pages have.
WIDE, RARE = 4_000, 64


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, without its port; empty where there is none."""
    return F.lower(F.regexp_extract(
        F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks are joined by a line feed. A null or empty html, and a page without
    content, gives an empty text; a page without a host belongs to the host with
    the empty name. Repeated rows stay, and count once when the host's pages are
    aligned; other columns do not matter. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = wrappers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, host, wrapper in zip(*(batch.column(c) for c in ("html", "host", "wrapper"))):
                name = host.as_py() if wrapper.is_valid else None
                if name is not None and name not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[name] = json.loads(wrapper.as_py())
                texts.append(extract(html.as_py(), known.get(name)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(found, "host", "left").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper) for each host of ``rows`` (page_id, url, host, html) whose wrapper has template nodes."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [_dump(sketch_of(h.as_py())) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.binary())], ["host", "tree"])

    def align(table: pa.Table) -> pa.Table:
        trees = (json.loads(t) for _, t in sorted(zip(*(table.column(c).to_pylist() for c in ("deal", "tree")))))
        merged = next(trees)
        for tree in trees:
            merged = merge(merged, tree)
        return pa.table([table.column("host")[:1], table.column("deal")[:1], pa.array([_dump(merged)], pa.binary())],
                        names=["host", "deal", "tree"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [t if has_template(json.loads(t)) else None for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(marked, pa.binary())], ["host", "wrapper"])

    # copies of a page say nothing about what pages have in common: they count once
    sketches = rows.select("host", "html").mapInArrow(sketch, "host string, tree binary").distinct()
    trees = stored(sketches.withColumn("deal", F.xxhash64("tree")), "wrapper-trees")
    left = -1
    while left != 1:
        # as many groups as hold GROUP trees each; the counts are one narrow row per host
        groups = trees.groupBy("host").agg(F.count("*").alias("n")).select("host", F.ceil(F.col("n") / GROUP).alias("groups"))
        left = groups.agg(F.max("groups")).first()[0] or 1
        met = trees.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("deal", F.lit(left)), "groups"))
        # dealt by both columns: grouping alone would be content with a partitioning by host
        trees = stored(met.repartition("host", "part").groupBy("host", "part").applyInArrow(
            align, "host string, deal long, tree binary"), "wrapper-trees")
    return stored(trees.select("host", "tree").mapInArrow(mark, "host string, wrapper binary").where(
        "wrapper IS NOT NULL"), "wrappers")


# ---------------------------------------------------------------------------
# Folded trees. A node is a dict: n, its pages; t, pages by text digest; c, its
# groups of children in page order, each a dict from label to node.
# ---------------------------------------------------------------------------

def _dump(tree: dict) -> bytes:
    return json.dumps(tree, separators=(",", ":")).encode()


def sketch_of(html: str) -> dict:
    """The folded tree of a page."""
    return _sketch(_folded([dom.parse(html)]))


def _folded(elements: list[dom.Element]) -> dict:
    """One node for ``elements`` of one label at one place; elements without text are left out."""
    groups: list[dict] = []
    for element in elements:
        children = [c for c in element.elements() if c.chars]
        own = []
        for stretch in _stretches(children):
            group: dict[str, list] = {}
            for child in stretch:
                group.setdefault(child.label, []).append(child)
            own.append(group)
        groups = _join(groups, own, lambda a, b: a + b)
    return {"e": elements, "c": [{label: _folded(e) for label, e in group.items()} for group in groups]}


def _sketch(node: dict) -> dict:
    texts = sorted({e.digest for e in node["e"] if e.chars})
    return {"n": 1, "t": dict.fromkeys(texts, 1) if len(texts) <= ITERATED else {}, "c": [
        {label: _sketch(below) for label, below in group.items()} for group in node["c"]]}


def _stretches(children: list[dom.Element]) -> list[list[dom.Element]]:
    """Cuts a sequence into the shortest stretches that keep equal labels together."""
    last = {c.label: i for i, c in enumerate(children)}
    out: list[list[dom.Element]] = []
    end = -1
    for i, child in enumerate(children):
        if i > end:
            out.append([])
        out[-1].append(child)
        end = max(end, last[child.label])
    return out


def match(a: list[dict], b: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two sequences of groups: (matched nodes, pairs of matched groups)."""
    if not a or not b:
        return 0, []
    weight = [[_matched(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, row in enumerate(weight, 1):
        for j, w in enumerate(row, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def _matched(x: dict, y: dict) -> int:
    """Nodes that two groups share: their common labels and what matches below them."""
    return sum(1 + (match(x[label]["c"], y[label]["c"])[0] if isinstance(x[label], dict) else 0)
               for label in x.keys() & y.keys())


def _join(a: list[dict], b: list[dict], both: Callable) -> list[dict]:
    """Two sequences of groups aligned; ``both`` makes one node of two.

    A label that stands at two places afterwards, because the sequences order it
    differently, makes one group of all between them.
    """
    if not a or not b:
        return a or b
    out: list[dict] = []
    i = j = 0
    for x, y in [*match(a, b)[1], (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append(_one(a[x], b[y], both))
        i, j = x + 1, y + 1
    last = {label: k for k, group in enumerate(out) for label in group}
    joined: list[dict] = []
    end = -1
    for k, group in enumerate(out):
        if k > end:
            joined.append(group)
        else:
            joined[-1] = _one(joined[-1], group, both)
        end = max(end, *(last[label] for label in group))
    return joined


def _one(x: dict, y: dict, both: Callable) -> dict:
    return {**x, **{label: both(x[label], node) if label in x else node for label, node in y.items()}}


def merge(a: dict, b: dict) -> dict:
    """Two wrappers, of different pages of one host, as one."""
    whole = _merge(a, b)
    if _size(whole) > WIDE:
        _forget(whole, whole["n"] / RARE)
    return whole


def _merge(a: dict, b: dict) -> dict:
    texts = dict(a["t"])
    for text, n in b["t"].items():
        texts[text] = texts.get(text, 0) + n
    if len(texts) > TEXTS:
        cut = sorted(texts.values(), reverse=True)[TEXTS]
        texts = {t: n - cut for t, n in texts.items() if n > cut}
    return {"n": a["n"] + b["n"], "t": texts, "c": _join(a["c"], b["c"], _merge)}


def _size(node: dict) -> int:
    return 1 + sum(_size(below) for group in node["c"] for below in group.values())


def _forget(node: dict, least: float) -> None:
    kept = [{label: below for label, below in group.items() if below["n"] >= least} for group in node["c"]]
    node["c"] = [group for group in kept if group]
    for group in node["c"]:
        for below in group.values():
            _forget(below, least)


def has_template(tree: dict) -> bool:
    def below(node: dict) -> bool:
        return any(max(x["t"].values(), default=0) >= CONSTANT * tree["n"] or below(x)
                   for group in node["c"] for x in group.values())

    return tree["n"] >= LEAST_PAGES and below(tree)


def template_elements(page: dom.Element, wrapper: dict) -> set[int]:
    """Ids of the page's elements that stand, with the template's text, at a template place."""
    found: set[int] = set()
    least = CONSTANT * wrapper["n"]

    def walk(node: dict, known: dict) -> None:
        for i, j in match(node["c"], known["c"])[1]:
            for label in node["c"][i].keys() & known["c"][j].keys():
                own, place = node["c"][i][label], known["c"][j][label]
                fixed = {e.digest: e for e in own["e"] if place["t"].get(e.digest, 0) >= least}
                found.update(id(e) for e in own["e"] if e.digest in fixed)
                if len(own["e"]) > len(fixed) or not fixed:
                    walk(own, place)

    if wrapper["n"] >= LEAST_PAGES:
        walk(_folded([page]), wrapper)
    return found


# ---------------------------------------------------------------------------
# From a page to its main text.
# ---------------------------------------------------------------------------

# Elements and roles that are never content, and words of ids and classes that say so.
NOT_CONTENT = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea label fieldset "
    "iframe object embed canvas svg audio video map dialog menu search datalist".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist "
    "tooltip status".split())
WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars widget widgets ad ads adv advert "
    "adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners cookie "
    "cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist disqus respond "
    "replies pagination pager skip toolbar masthead copyright".split())
HEADERS = frozenset("header topbar".split())  # of a page, unless they belong to an article
BODIES = frozenset("article post entry story content main body".split())
_PROTECTED = frozenset("#page html body main article".split())
_CONTENT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())


def _words(element: dom.Element) -> set[str]:
    names = f"{element.attributes.get('id', '')} {element.attributes.get('class', '')}"
    spaced = "".join(f" {c}" if c.isupper() else c if c.isalpha() else " " for c in names)
    return {*spaced.lower().split(), *names.lower().replace("-", " ").replace("_", " ").split()}


def not_content(element: dom.Element, in_article: bool) -> bool:
    """Whether an element says by itself that it, with all below it, is not main text."""
    tag, attributes = element.tag, element.attributes
    if tag in NOT_CONTENT:
        return True
    if not attributes:
        return tag == "header" and not in_article
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    words = _words(element)
    if tag == "article":
        return bool(words & {"comment", "comments", "reply"})
    if tag in _PROTECTED:
        return False
    if words & WORDS:
        return True
    return (tag == "header" or bool(words & HEADERS)) and not in_article and not words & BODIES


def _links(element: dom.Element) -> tuple[int, int]:
    """Characters of links below an element and their number."""
    chars = number = 0
    for child in element.elements():
        c, n = (child.chars, 1) if child.tag == "a" else _links(child)
        chars, number = chars + c, number + n
    return chars, number


def _link_list(element: dom.Element) -> bool:
    if element.tag not in ("ul", "ol", "div", "section", "table", "p", "dl"):
        return False
    chars, number = _links(element)
    return number >= 2 and chars >= 0.6 * element.chars


def _main_parts(page: dom.Element) -> tuple[dom.Element, bool]:
    """The element that holds the article, and whether it says so itself."""
    mains: list[dom.Element] = []
    articles: list[dom.Element] = []
    contents: list[dom.Element] = []

    def walk(element: dom.Element) -> None:
        for child in element.elements():
            if not child.chars or not_content(child, False):
                continue
            if child.tag == "main" or child.attributes.get("role", "").lower() == "main":
                mains.append(child)
            elif child.tag == "article" or child.attributes.get("itemprop", "").lower() == "articlebody":
                articles.append(child)
            else:
                if child.tag in ("div", "section", "td") and _words(child) & BODIES:
                    contents.append(child)
                walk(child)

    walk(page)
    for found in (mains, articles):
        if found:
            return max(found, key=lambda e: e.chars), True
    body = next((e for e in _below(page, "body")), page)
    kept = sum(map(len, dom.blocks(body, lambda e: not_content(e, False) or _link_list(e))))
    for content in sorted(contents, key=lambda e: -e.chars)[:1]:
        inside = sum(map(len, dom.blocks(content, lambda e: not_content(e, True) or _link_list(e))))
        titles = [e for e in _below(body, "h1") if e.chars]
        if inside >= 0.5 * kept and (not titles or any(e in titles for e in _below(content, "h1"))):
            return content, False
    return body, False


def _below(element: dom.Element, tag: str) -> Iterator[dom.Element]:
    for child in element.elements():
        if child.tag == tag:
            yield child
        yield from _below(child, tag)


def extract(html: str, wrapper: dict | None = None) -> str:
    """Main text of one page, given its host's wrapper."""
    page = dom.parse(html)
    root, stated = _main_parts(page)

    def boilerplate(element: dom.Element) -> bool:
        return not_content(element, stated) or (not stated and _link_list(element))

    lines = dom.blocks(root, boilerplate)
    if wrapper is not None:
        fixed = template_elements(page, wrapper)
        # headings and paragraphs of a stated article are its own even if all pages share them
        own = dom.blocks(root, lambda e: boilerplate(e) or (
            id(e) in fixed and not (stated and e.tag in _CONTENT_TAGS and not e.attributes)))
        # a page with nothing of its own is a variant of the host's other pages
        lines = own or lines
    return "\n".join(lines)

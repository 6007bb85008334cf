"""Element trees of web pages as they come: unclosed, misnested, cut off in the middle."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import blake2b
from html import unescape

MAX_DEPTH = 120  # elements nested deeper become siblings; their text stays

# Elements of HTML by what they do to the tree and the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt head html body legend li option tbody td tfoot th thead tr".split())
# a start tag of the key ends an open element of the first list, unless one of the second stands between
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("table td th caption template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
_DIGITS = re.compile(r"\d+")


class Element:
    """``label`` tells elements of one kind apart: tag, id and classes, digits left out."""

    __slots__ = ("tag", "attributes", "label", "parts", "digest", "chars")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        names = [attributes.get("id", ""), *sorted(attributes.get("class", "").split())]
        self.label = ".".join([tag, *(_DIGITS.sub("#", n) for n in names if n)])
        self.parts: list[Element | str] = []
        self.digest, self.chars = "", 0

    def elements(self) -> list["Element"]:
        return [p for p in self.parts if isinstance(p, Element)]

    def seal(self) -> None:
        """Length of the text below (no white space) and a digest of it, from the children's."""
        marks = []
        for part in self.parts:
            if isinstance(part, Element):
                part.seal()
                self.chars += part.chars
                if part.chars:
                    marks.append(part.digest)
            else:
                words = part.split()
                self.chars += sum(map(len, words))
                marks += words
        self.digest = blake2b(" ".join(marks).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if marks else ""


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


def parse(html: str) -> Element:
    """The tree under one root element; text of scripts and styles is left out, character references are decoded.

    A tag that the end of the page cuts off is dropped, an unclosed comment runs to the end.
    """
    root = Element("#page", {})
    stack, depth = [root], 0
    at, size = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(unescape(piece) if "&" in piece else piece)

    def open_index(tags: tuple[str, ...], barriers) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in barriers:
                return 0
        return 0

    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            text(html[at:])
            break
        following = html[mark + 1:mark + 2]
        if following == "/" and not html[mark + 2:mark + 3].isalpha():
            following = "!"
        if following in ("!", "?") and following:
            text(html[at:mark])
            close, width = (html.find("-->", mark + 4), 3) if html.startswith("<!--", mark) else (html.find(">", mark), 1)
            if html.startswith(("<!-->", "<!--->"), mark):
                close, width = html.find(">", mark), 1
            at = size if close < 0 else close + width
            continue
        name = _NAME.match(html, mark + (2 if following == "/" else 1))
        if name is None or not name.group()[0].isascii():
            text(html[at:mark + 1])
            at = mark + 1
            continue
        text(html[at:mark])
        end = _REST.match(html, name.end())
        stop = end.end() if end else html.find(">", name.end()) + 1
        if not stop:
            break
        tag = name.group().lower()
        at = stop
        if following == "/":
            if tag == "br":
                stack[-1].parts.append(Element("br", {}))
            elif tag == "p" and not open_index(("p",), SCOPE):
                stack[-1].parts.append(Element("p", {}))
            elif found := open_index((tag,), SCOPE - {tag} if tag not in SCOPE else ()):
                # the end of an inline element does not end the blocks opened inside it
                if tag in BLOCK or not any(e.tag in BLOCK for e in stack[found + 1:]):
                    del stack[found:]
            continue
        if tag in CLOSES_P and (found := open_index(("p",), SCOPE)):
            del stack[found:]
        if tag in IMPLIED:
            ended, barriers = IMPLIED[tag]
            if found := open_index(ended, barriers):
                del stack[found:]
        inside = html[name.end():stop - 1]
        if tag in ("html", "body") and (found := open_index((tag,), ())):
            for key, value in _attributes(inside).items():
                stack[found].attributes.setdefault(key, value)
            continue
        element = Element(tag, _attributes(inside) if inside.strip(" /") else {})
        stack[-1].parts.append(element)
        if tag in RAW:
            close = _ENDS[tag].search(html, at)
            until = close.start() if close else size
            if tag in ("title", "textarea"):
                element.parts.append(unescape(html[at:until]))
            after = html.find(">", until) if close else -1
            at = after + 1 if after >= 0 else size
        elif tag not in VOID and not (inside.endswith("/") and tag in ("svg", "path", "g")) and len(stack) <= MAX_DEPTH:
            stack.append(element)
    root.seal()
    return root


def blocks(root: Element, leave_out: Callable[[Element], bool]) -> list[str]:
    """Texts of the blocks below ``root`` in page order, each run of white space one space."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        line = " ".join("".join(buffer).split())
        buffer.clear()
        if line:
            out.append(line)

    def walk(element: Element) -> None:
        for part in element.parts:
            if isinstance(part, str):
                buffer.append(part)
            elif part.tag == "br":
                buffer.append(" ")
            elif not part.chars or leave_out(part):
                if part.tag in BLOCK:
                    flush()
            elif part.tag in BLOCK:
                flush()
                walk(part)
                flush()
            else:
                walk(part)

    walk(root)
    flush()
    return out

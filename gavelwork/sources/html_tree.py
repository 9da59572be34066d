"""A small element tree for one page, used inside page tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from itertools import repeat

# Elements that never have an end tag, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))

_PATTERN = r"""<!--.*?-->|<[!?][^>]*>
    |<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"""
_MARKUP = re.compile(_PATTERN, re.S | re.X)
_SPLIT = re.compile(f"({re.sub(r'[?]P<[a-z0-9]+>', '?:', _PATTERN)})", re.S | re.X)
_RAW_START = re.compile(f"<(?:{'|'.join(RAW)})", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Element:
    """An element; its descendants and the texts below it are runs of the page's lists, in document order."""

    __slots__ = ("tag", "attrs", "classes", "parent", "page", "begin", "end", "known")

    def __init__(self, tag: str, attrs: dict, classes: list[str], parent: "Element | None", page: tuple[list["Element"], list[str]],
                 begin: tuple[int, int]):
        self.tag, self.attrs, self.classes, self.parent, self.page = tag, attrs, classes, parent, page
        self.begin = self.end = begin
        self.known: dict | None = None

    def once(self, name: str, work: Callable[["Element"], object]):
        """What ``work`` finds on this element, worked out once for all that ask."""
        if self.known is None:
            self.known = {}
        if name not in self.known:
            self.known[name] = work(self)
        return self.known[name]

    def walk(self) -> list["Element"]:
        """Descendants in document order."""
        return self.page[0][self.begin[0]:self.end[0]]

    def texts(self) -> list[str]:
        return self.page[1][self.begin[1]:self.end[1]]

    def text(self, strip: bool = False) -> str:
        return "".join([t.strip() for t in self.texts()] if strip else self.texts())

    def all(self, test: Callable[["Element"], bool]) -> list["Element"]:
        return [n for n in self.walk() if test(n)]

    def first(self, test: Callable[["Element"], bool]) -> "Element | None":
        for node in self.walk():
            if test(node):
                return node
        return None

    def above(self) -> Iterator["Element"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def _attributes(source: str) -> tuple[dict, list[str]]:
    """Attributes and class tokens of a start tag."""
    found: dict = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source) if source else ():
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found, (found.get("class") or "").split()


#: Kinds of markup: no element, the end of one, the start of one that has an end, is raw, or is closed at once.
_NONE, _END, _START, _RAW, _VOID = range(5)
#: Different texts of markup that are remembered.
MARKUP = 10_000


def _understood(whole: str) -> tuple[int, str, dict, list[str]]:
    """Kind, tag, attributes and class tokens of one piece of markup."""
    match = _MARKUP.match(whole)
    end, tag, source, end2, tag2, source2 = match.groups() if match else [None] * 6
    tag, source = (tag or tag2 or "").lower(), source or source2 or ""
    if not tag or end or end2:
        return (_END if tag else _NONE), tag, {}, []
    kind = _RAW if tag in RAW else _VOID if tag in VOID or source.endswith("/") else _START
    return kind, tag, *_attributes(source)


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """Texts, each with the markup that follows and its raw content; the last text has none."""
    if not _RAW_START.search(html):
        parts = [*_SPLIT.split(html), ""]
        return zip(parts[::2], parts[1::2], repeat(""))
    return _raw_pieces(html)


def _raw_pieces(html: str) -> Iterator[tuple[str, str, str]]:
    position, match = 0, _MARKUP.search(html)
    while match:
        text, position, raw = html[position:match.start()], match.end(), ""
        tag = (match["tag"] or match["tag2"] or "").lower()
        if tag in RAW and not (match["end"] or match["end2"]):
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, position)
            raw = html[position:close.start() if close else len(html)]
            position = close.end() if close else len(html)
        yield text, match[0], raw
        match = _MARKUP.search(html, position)
    yield html[position:], "", ""


def parse(html: str | None, known: dict | None = None) -> Element:
    """Elements and texts of a page; an end tag closes the nearest open element of its name.

    ``known`` remembers what pieces of markup mean from page to page. Tags of the same text share their
    attributes, so these are only read.
    """
    known = {} if known is None else known
    nodes: list[Element] = []
    texts: list[str] = []
    page = nodes, texts
    root = at = Element("", {}, [], None, page, (0, 0))
    for source, whole, raw in _pieces(html or ""):
        if source:
            texts.append(unescape(source) if "&" in source else source)
        meaning = known.get(whole)
        if meaning is None:
            if len(known) >= MARKUP:
                known.clear()
            meaning = known[whole] = _understood(whole)
        kind, tag, attrs, classes = meaning
        if kind == _END:
            if at.tag == tag:
                at.end, at = (len(nodes), len(texts)), at.parent
                continue
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                here = len(nodes), len(texts)
                while at is not node:
                    at.end, at = here, at.parent
                at.end, at = here, at.parent
        elif kind:
            node = Element(tag, attrs, classes, at, page, (len(nodes) + 1, len(texts)))  # the element itself is added next
            nodes.append(node)
            if kind == _START:
                at = node
            elif raw:
                texts.append(raw)
                node.end = len(nodes), len(texts)
    here = len(nodes), len(texts)
    while at is not None:
        at.end, at = here, at.parent
    return root


def tagged(tag: str, token: str | None = None, like: str | None = None) -> Callable[[Element], bool]:
    """Test for a tag with a class token, or with a class token containing a text."""
    def test(node: Element) -> bool:
        if node.tag != tag and tag != "*":
            return False
        if token is not None and token not in node.classes:
            return False
        return like is None or any(like in c for c in node.classes)

    return test

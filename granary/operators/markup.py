"""Records from HTML pages by declared fields.

Pages go through one Arrow-batched step that walks each page once with the
standard parser; selectors are the small subset that catalogue rules need: tag,
``#id``, ``.class``, ``[attr]``, ``[attr=value]``, descendant and child steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Start tag: the open elements that it ends, and the elements around them where the search stops.
_SCOPE = frozenset("table td th caption button object template select".split())
_ENDS = {
    "li": (frozenset(("li", "p")), _SCOPE | {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd", "p")), _SCOPE | {"dl"})),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("table", "tr", "template")))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table", "template"))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), frozenset(("table", "template")))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 address article aside blockquote div dl fieldset footer form header hr main nav ol pre section table ul".split(), (frozenset(("p",)), _SCOPE)),
}
_NO_END = (frozenset(), frozenset())
_AND = re.compile(r"&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")


# Attributes that hold addresses, and beginnings of what is no address of a page.
LINK_ATTRIBUTES = ("href", "src", "data-src", "data-original", "data-lazy", "data-href")
NO_LINK = ("#", "javascript:", "mailto:", "tel:", "data:")


@dataclass(frozen=True)
class Field:
    """A value: ``css`` selects, ``attr`` reads (text, own_text without that of inner elements,
    or an attribute), ``pattern`` cuts out. What follows is for ``fields.typed``."""

    name: str
    css: str = ""
    attr: str = "text"
    pattern: str | None = None
    many: bool = False
    kind: str = "str"
    mapping: dict[str, str] | None = None
    default: object = None
    required: bool = False


@dataclass(frozen=True)
class Specs:
    """A table of properties: ``key`` and ``value`` select within each of ``rows``, or,
    without ``rows``, parallel lists of the page (``dt`` and ``dd``)."""

    key: str
    value: str
    rows: str = ""
    prefix: str = ""
    only: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, _Node):
                yield c
                stack.extend(reversed(c.children))

    def text(self):
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    """Tree of a page, of any depth; elements whose end tag may be left out end where the next one starts.

    Browsers also read some character references without their semicolon; without ``bare`` those stay text.
    """

    def __init__(self, text: str, bare: bool = True):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.open = Counter()  # tags of the elements from the root to ``at``
        self.held = None  # a character that the page does not have, in place of "&" that begins no whole reference
        if not bare and "&" in text:
            self.held = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in text)
            text = _AND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else self.held + m[0][1:], text)
        self.feed(text)
        self.close()

    def whole(self, text: str | None) -> str:
        text = text or ""
        return text.replace(self.held, "&") if self.held else text

    def up(self, node):
        """Close ``node`` and all that is open in it."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        ended, inside = _ENDS.get(tag, _NO_END)
        if any(self.open[t] for t in ended):
            node, last = self.at, None
            while node.parent is not None and node.tag not in inside:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                self.up(last)
        node = _Node(tag, {k: self.whole(v) for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self.up(node)

    def handle_data(self, data):
        self.at.children.append(self.whole(data))


_STEP = re.compile(r"([\w*-]+)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)")
_MARK = re.compile(r"#[\w-]+|\.[\w-]+|\[[^\]]+\]")


@lru_cache(maxsize=1024)
def _steps(css: str) -> tuple:
    """The steps of a selector, read once for all pages: ">", or a tag (None: any) and its marks."""
    out = []
    for s in css.replace(">", " > ").split():
        found = _STEP.fullmatch(s)
        if s != ">" and not found:
            raise ValueError(f"selector not supported: {css}")
        out.append(s if s == ">" else (found[1] if found[1] != "*" else None, tuple(_MARK.findall(found[2] or ""))))
    return tuple(out)


def _matches(node: _Node, step: tuple) -> bool:
    tag, marks = step
    if tag and tag != node.tag:
        return False
    for mark in marks:
        if mark[0] == "#" and node.attrs.get("id") != mark[1:]:
            return False
        if mark[0] == "." and mark[1:] not in node.attrs.get("class", "").split():
            return False
        if mark[0] == "[":
            name, found, value = mark[1:-1].partition("=")
            if name not in node.attrs or (found and node.attrs[name] != value.strip("\"'")):
                return False
    return True


def select(root: _Node, css: str) -> list[_Node]:
    """Nodes that match a selector, in document order."""
    if css in ("", ":self"):
        return [root]
    steps = _steps(css)
    if len(steps) == 1:
        return [n for n in root.walk() if _matches(n, steps[0])]

    def fits(node, k):
        if not _matches(node, steps[k]):
            return False
        if k == 0:
            return True
        if steps[k - 1] == ">":
            return node.parent is not None and fits(node.parent, k - 2)
        up = node.parent
        while up is not None:
            if fits(up, k - 1):
                return True
            up = up.parent
        return False

    return [n for n in root.walk() if fits(n, len(steps) - 1)]


def _value(node: _Node, field: Field, url: str) -> str | None:
    if field.attr == "text":
        raw = node.text()
    elif field.attr == "own_text":
        raw = " ".join(c for c in node.children if isinstance(c, str))
    else:
        raw = node.attrs.get(field.attr)
    if raw and field.pattern:
        found = re.search(field.pattern, raw)
        raw = found.group(found.re.groups and 1) if found else None
    if raw is not None and (field.attr in LINK_ATTRIBUTES or field.kind == "url"):
        raw = None if raw.strip().startswith(NO_LINK) else urljoin(url, raw.strip())
    return " ".join(raw.split()) or None if raw else None


def extract(pages: DataFrame, fields: list[Field], card: str = "", page_id: str = "page_id", url: str = "url", html: str = "html", bare: bool = True) -> DataFrame:
    """A row for each card of each page (one card, the page, by default) with the declared fields.

    Fields are strings, or arrays of strings with ``many``; what is not found is null.
    Broken markup is read as far as it goes; a null page has one card without values.
    ``bare``: ``&amp`` and its like count without a semicolon too, as in browsers.
    """
    kinds = [T.StructField(f.name, T.ArrayType(T.StringType()) if f.many else T.StringType()) for f in fields]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("card", T.IntegerType()), *kinds])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, at, text in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                tree = _Tree(text or "", bare)
                for n, node in enumerate(select(tree.root, card)):
                    record: list = [key, n]
                    for f in fields:
                        values = [v for v in (_value(x, f, at or "") for x in select(node, f.css)) if v]
                        record.append(values if f.many else (values[0] if values else None))
                    out.append(record)
            yield pd.DataFrame(out, columns=schema.names)

    return pages.selectExpr(f"{page_id} as page_id", f"{url} as url", f"{html} as html").mapInPandas(rows, schema)


def specs(pages: DataFrame, spec: Specs, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, name, value) of the properties of each page; of a name found twice the last value counts.

    Names lose colons at their end; ``only`` and ``without`` name those wanted and
    unwanted. Rows without a key or a value, keys without a partner and empty names are
    left out; a null page has none.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["page_id"], batch["html"], strict=True):
                tree = _Tree(text or "")
                if spec.rows:
                    found = [(select(row, spec.key), select(row, spec.value)) for row in select(tree.root, spec.rows)]
                    pairs = [(k[0], v[0]) for k, v in found if k and v]
                else:
                    pairs = list(zip(select(tree.root, spec.key), select(tree.root, spec.value), strict=False))
                named = {k.text().rstrip(":").strip(): v.text() for k, v in pairs}
                out.extend((key, spec.prefix + k, v) for k, v in named.items() if k and k not in spec.without and (not spec.only or k in spec.only))
            yield pd.DataFrame(out, columns=["page_id", "name", "value"])

    return pages.selectExpr(f"cast({page_id} as long) as page_id", f"{html} as html").mapInPandas(rows, "page_id long, name string, value string")

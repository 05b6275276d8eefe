"""A tolerant tree builder for HTML, and a strict reader for XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes, up to the nearest of its scope.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A character reference begins here, whole up to its semicolon or not.
_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)?")
#: Characters that a reference can't name, before all others from the private ones on.
_NONCHARACTERS, _OTHERS = range(0xFDD0, 0xFDF0), range(0xE000, 0x110000)
_P_SCOPE = ("td", "th", "table", "body", "html")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def elements(self):
        return (c for c in self.children if isinstance(c, Element))

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, tag: str):
        for c in self.elements():
            if c.tag == tag:
                return c
            if (found := c.find(tag)) is not None:
                return found
        return None


def _loose_marked(text: str) -> tuple[str, str]:
    """A text with a character it doesn't hold for each ``&`` that begins no whole reference, and that character.

    Only a reference with its semicolon is one: ``&amp`` at a cut, or ``?a=1&copy=2``, is what it says."""
    mark = next(c for c in map(chr, chain(_NONCHARACTERS, _OTHERS)) if c not in text)
    whole = lambda m: m[1] and (m[1][0] == "#" or m[1] + ";" in html5)
    return _REFERENCE.sub(lambda m: m[0] if whole(m) else mark + m[0][1:], text), mark


class _Builder(HTMLParser):
    def __init__(self, loose: str):
        super().__init__(convert_charrefs=True)
        self.loose = loose
        self.root = Element("root")
        self.stack = [self.root]

    def _close(self, tags, scope) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return

    def _said(self, text: str) -> str:
        return text.replace(self.loose, "&")

    def handle_starttag(self, tag, attrs):
        tag = self._said(tag)
        if tag in ENDS_P:
            self._close(("p",), _P_SCOPE)
        if tag in CLOSES and tag != "p":
            for _ in CLOSES[tag]:
                self._close(CLOSES[tag], SCOPE.get(tag, _P_SCOPE))
        if tag in ("html", "body") and any(e.tag == tag for e in self.stack):
            return
        made = Element(tag, {self._said(k): self._said(v or "") for k, v in attrs})
        self.stack[-1].children.append(made)
        if tag not in VOID:
            self.stack.append(made)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == self._said(tag):
            self.stack.pop()

    def handle_endtag(self, tag):
        tag = self._said(tag)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return

    def handle_data(self, data):
        self.stack[-1].children.append(self._said(data))


def parse_html(text: str) -> Element:
    """The tree of a page; comments and declarations are left out, and nothing makes it fail."""
    marked, loose = _loose_marked(text)
    made = _Builder(loose)
    made.feed(marked)
    made.close()
    return made.root


class RefusedXml(ValueError):
    """XML with a document type: entities could expand without bound."""


def parse_xml(content: bytes | str) -> ET.Element:
    head = content[:4096] if isinstance(content, str) else content[:4096].decode("utf-8", "replace")
    if re.search(r"<!DOCTYPE|<!ENTITY", head, re.I):
        raise RefusedXml("document types are refused")
    return ET.fromstring(content)


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""

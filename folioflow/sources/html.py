"""HTML pages as outlines."""

from __future__ import annotations

import re

from folioflow.sources.markup import Element, parse_html
from folioflow.sources.nodes import Outline, cell, flat_items, run

HEADINGS = {f"h{i}": i for i in range(1, 7)}
SKIPPED = frozenset(("script", "style", "meta", "link", "head", "title"))
CONTAINERS = frozenset(("div", "article", "main", "section", "body", "html", "root", "header", "footer", "nav", "aside"))
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code", "del": "strike", "s": "strike", "strike": "strike"}
#: Elements that hold no main content, and how much of a part's text may stand in links.
BOILERPLATE = frozenset(("nav", "header", "footer", "aside", "form", "script", "style", "noscript"))
LINK_SHARE = 0.5
MAX_DEPTH = 3


def runs_of(elem: Element, skip: frozenset = frozenset(), **marks) -> list[dict]:
    """Inline runs with the marks of the elements around them; white space stays, empty runs don't."""
    out: list[dict] = []
    for c in elem.children:
        if isinstance(c, str):
            if c:
                out.append(run(c, **marks))
        elif c.tag in skip:
            continue
        elif c.tag == "a":
            out += runs_of(c, skip, **(marks | {"href": c.attrs.get("href") or marks.get("href")}))
        else:
            own = {MARKS[c.tag]: True} if c.tag in MARKS else {}
            out += runs_of(c, skip, **(marks | own))
    return out


def list_entries(elem: Element, depth: int = 0, own_text_only: bool = False) -> list[tuple[int, bool, list[dict]]]:
    """Items to three levels. An item's text holds that of the lists in it, unless ``own_text_only``."""
    out = []
    for li in elem.elements():
        if li.tag != "li":
            continue
        out.append((depth, elem.tag == "ol", runs_of(li, frozenset(("ul", "ol")) if own_text_only else frozenset())))
        if depth < MAX_DEPTH - 1:
            for sub in li.elements():
                if sub.tag in ("ul", "ol"):
                    out += list_entries(sub, depth + 1, own_text_only)
    return out


def table_rows(elem: Element, wrap: bool = False, first_is_header: bool = True) -> list[list[dict]]:
    """Rows of cells; without a header cell in the first row, all of it heads if ``first_is_header``.

    ``wrap`` makes a cell one part and keeps spans."""
    rows = []
    for part in elem.elements():
        for tr in [part] if part.tag == "tr" else [r for r in part.elements() if r.tag == "tr"] if part.tag in ("thead", "tbody", "tfoot") else []:
            cells = []
            for td in tr.elements():
                if td.tag in ("td", "th"):
                    runs = runs_of(td)
                    spans = {k: int(td.attrs[k]) for k in ("colspan", "rowspan") if wrap and td.attrs.get(k, "").isdigit()}
                    cells.append(cell(header=td.tag == "th", parts=[runs] if wrap else [[r] for r in runs], **spans))
            if cells:
                rows.append(cells)
    if rows and first_is_header and not any(c["header"] for c in rows[0]):
        for c in rows[0]:
            c["header"] = True
    return rows


def walk(elem: Element, out: Outline) -> None:
    """Blocks of an element's children. Text that stands directly in a container is left out."""
    for e in elem.elements():
        if e.tag in SKIPPED:
            continue
        if e.tag in HEADINGS:
            out.open(HEADINGS[e.tag], runs_of(e))
        elif e.tag == "p":
            if runs := runs_of(e):
                out.paragraph(runs)
        elif e.tag in ("ul", "ol"):
            if entries := list_entries(e):
                out.items(flat_items(entries))
        elif e.tag == "table":
            if rows := table_rows(e):
                out.table(rows)
        elif e.tag in ("pre", "code"):
            if text := e.text().strip():
                out.code(text)
        elif e.tag == "img":
            out.image(alt=e.attrs.get("alt") or None)
        elif e.tag in CONTAINERS:
            walk(e, out)
        elif text := e.text().strip():
            out.paragraph(text)


def page_words(raw: str) -> int | None:
    return len(re.sub(r"<[^>]+>", " ", raw).split()) or None


def main_content(root: Element) -> Element | None:
    """The tree without parts that are boilerplate by element or by how much of them is links; null if nothing is left."""

    def linked(e: Element) -> int:
        return sum(len(c.text()) if c.tag == "a" else linked(c) for c in e.elements())

    def pruned(e: Element) -> Element:
        kept = []
        for c in e.children:
            if isinstance(c, str):
                kept.append(c)
            elif c.tag not in BOILERPLATE:
                size = len(c.text())
                if c.tag in ("div", "section", "ul", "ol", "table") and size and linked(c) > LINK_SHARE * size:
                    continue
                kept.append(pruned(c))
        return Element(e.tag, e.attrs, kept)

    article = root.find("article") or root.find("main") or root
    left = pruned(article)
    return left if left.text().strip() else None


def parse(content: bytes, options: dict) -> Outline:
    """``options['extract_content']`` takes the main content alone."""
    raw = content.decode("utf-8", "replace")
    out = Outline("html")
    root = parse_html(raw)
    if title := root.find("title"):
        out.metadata["title"] = title.text().strip() or None
    out.metadata["word_count"] = page_words(raw)
    if options.get("extract_content"):
        found = main_content(root)
        if found is None:
            out.warn("content_extracted", "No main content was found; the whole page is used.")
        root = found or root
    walk(root, out)
    return out

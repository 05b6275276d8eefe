"""Text documents and slides in Office Open XML as outlines."""

from __future__ import annotations

from folioflow.operators.images import PICTURE_TEXTS, SLIDE_NAMES
from folioflow.schema import MAX_TABLE_ROWS
from folioflow.sources.archives import Archive, properties
from folioflow.sources.markup import local
from folioflow.sources.nodes import Outline, capped, cell, flat_items, run

FOOTERS = frozenset(("dt", "ftr", "sldNum"))
TITLES = frozenset(("title", "ctrTitle"))
TITLE_BAND, TITLE_POINTS, TITLE_CHARS, LINE_CHARS = 0.15, 20.0, 120, 80
EMU_PER_POINT = 12700


def _kids(e, *tags: str) -> list:
    return [] if e is None else [c for c in e if local(c.tag) in tags]


def _first(e, *path: str):
    for tag in path:
        e = next(iter(_kids(e, tag)), None)
        if e is None:
            return None
    return e


def _attr(e, name: str, default=None):
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def _on(props, tag: str) -> bool:
    e = _first(props, tag)
    return e is not None and _attr(e, "val", "1") not in ("0", "false", "none")


# Text documents


def _document_runs(p, links: dict[str, str], href=None) -> list[dict]:
    out = []
    for e in p:
        tag = local(e.tag)
        if tag == "hyperlink":
            out += _document_runs(e, links, links.get(_attr(e, "id")) or href)
        elif tag in ("ins", "smartTag", "sdt", "sdtContent"):
            out += _document_runs(e, links, href)
        elif tag == "r":
            props = _first(e, "rPr")
            text = "".join((c.text or "") if local(c.tag) == "t" else "\t" if local(c.tag) == "tab" else "\n" if local(c.tag) in ("br", "cr") else "" for c in e)
            if text:
                out.append(run(text, bold=_on(props, "b"), italic=_on(props, "i"), strike=_on(props, "strike"), href=href))
    return out


def _styles(doc: Archive) -> dict[str, str]:
    root = doc.xml("word/styles.xml")
    return {} if root is None else {_attr(s, "styleId"): (_attr(_first(s, "name"), "val") or "").lower() for s in _kids(root, "style")}


def _numbered(doc: Archive) -> dict[tuple[str, int], bool]:
    """Whether a numbering's level counts."""
    root = doc.xml("word/numbering.xml")
    if root is None:
        return {}
    kinds = {_attr(a, "abstractNumId"): {int(_attr(lv, "ilvl", "0")): _attr(_first(lv, "numFmt"), "val") != "bullet" for lv in _kids(a, "lvl")} for a in _kids(root, "abstractNum")}
    return {(_attr(n, "numId"), lv): on for n in _kids(root, "num") for lv, on in kinds.get(_attr(_first(n, "abstractNumId"), "val"), {}).items()}


def _images(p, out: Outline, media: dict[str, str], mode: str) -> None:
    for e in p.iter():
        if local(e.tag) == "drawing":
            alt = next((_attr(d, "descr") or "" for d in e.iter() if local(d.tag) == "docPr"), "")
            rid = next((_attr(b, "embed") for b in e.iter() if local(b.tag) == "blip"), None)
            decorative = any(alt.lower().startswith(x) for x in PICTURE_TEXTS)
            if decorative:
                out.metadata["decorative_images"] = out.metadata.get("decorative_images", 0) + 1
            if mode != "suppress" and not decorative:
                out.image("unknown", media.get(rid), alt or None)


def parse_docx(content: bytes, options: dict) -> Outline:
    out = Outline("docx")
    doc = Archive(content)
    out.metadata = properties(doc)
    relations, styles, numbers = doc.relations("word/document.xml"), _styles(doc), _numbered(doc)
    mode = options.get("images", "extract")
    held: list = []
    words = 0

    def flush() -> None:
        if held:
            out.items(flat_items(held))
            held.clear()

    def rows_of(t) -> list[list[dict]]:
        rows = []
        for tr in _kids(t, "tr"):
            heads = _first(tr, "trPr", "tblHeader") is not None
            cells = []
            for tc in _kids(tr, "tc"):
                span = int(_attr(_first(tc, "tcPr", "gridSpan"), "val", "1"))
                parts = [r for p in _kids(tc, "p") if (r := _document_runs(p, relations))]
                cells.append(cell(header=heads, parts=parts, colspan=span))
            rows.append(cells)
        return rows

    def body(parent) -> None:
        nonlocal words
        for e in parent:
            tag = local(e.tag)
            if tag in ("sdt", "sdtContent"):
                body(e)
            elif tag == "tbl":
                flush()
                if rows := rows_of(e):
                    rows, cut, total = capped(rows, options.get("max_table_rows", MAX_TABLE_ROWS))
                    out.table(rows, truncated=cut, total_rows=total)
            elif tag == "p":
                props = _first(e, "pPr")
                style = styles.get(_attr(_first(props, "pStyle"), "val"), (_attr(_first(props, "pStyle"), "val") or "").lower())
                runs = _document_runs(e, relations)
                text = "".join(r["text"] for r in runs)
                words += len(text.split())
                _images(e, out, relations, mode)
                number = _first(props, "numPr")
                level = int(style[-1]) if style[:-1].strip() == "heading" and style[-1:].isdigit() else 1 if style == "title" else 0
                if level and text.strip():
                    flush()
                    out.open(min(level, 6), [r | {"bold": False} for r in runs])
                elif number is not None and text.strip():
                    depth = int(_attr(_first(number, "ilvl"), "val", "0"))
                    held.append((min(depth, len(held) and held[-1][0] + 1), numbers.get((_attr(_first(number, "numId"), "val"), depth), False), runs))
                elif text.strip():
                    flush()
                    out.paragraph(runs)

    main = doc.xml("word/document.xml")
    body(_first(main, "body"))
    flush()
    if any(local(e.tag) == "oMath" for e in main.iter()):
        out.warn("math_detected", "The document has formulas, which may be lost.")
    root = doc.xml("docProps/app.xml")
    pages = next((e.text for e in root if local(e.tag) == "Pages"), None) if root is not None else None
    out.metadata |= {"word_count": words or None, "page_count": int(pages) if (pages or "").isdigit() else None}
    return out


# Slides


def _slide_runs(p, links: dict[str, str]) -> list[dict]:
    out = []
    for e in p:
        if local(e.tag) in ("r", "fld"):
            props = _first(e, "rPr")
            text = (_first(e, "t").text or "") if _first(e, "t") is not None else ""
            href = links.get(_attr(_first(props, "hlinkClick"), "id"))
            if text:
                out.append(run(text, bold=_attr(props, "b") == "1", italic=_attr(props, "i") == "1", strike=_attr(props, "strike", "noStrike") != "noStrike", href=href))
        elif local(e.tag) == "br":
            out.append(run("\n"))
    return out


def bullet(p) -> tuple[bool, bool, int]:
    """Whether a paragraph is an item, counts, and its level: no bullet wins over a bullet, a character over a number, and both over a level."""
    props = _first(p, "pPr")
    level = int(_attr(props, "lvl", "0"))
    if _first(props, "buNone") is not None:
        return False, False, level
    if _first(props, "buChar") is not None:
        return True, False, level
    counts = _first(props, "buAutoNum") is not None
    return counts or level > 0, counts, level


def _frame(out: Outline, body, links: dict[str, str], skip: int = 0) -> int:
    """Paragraphs and islands of items; returns the words written."""
    held: list = []
    words = 0

    def flush() -> None:
        if held:
            least = min(d for d, _, _ in held)
            mixed = len({o for _, o, _ in held}) > 1  # a list that both counts and doesn't is taken as not counting
            entries, deepest = [], -1
            for d, o, r in held:
                deepest = min(d - least, deepest + 1)
                entries.append((deepest, o and not mixed, r))
            out.items(flat_items(entries))
            held.clear()

    for i, p in enumerate(_kids(body, "p")):
        runs = _slide_runs(p, links)
        text = "".join(r["text"] for r in runs)
        words += len(text.split())
        if i < skip or not text.strip():
            continue
        is_item, ordered, level = bullet(p)
        if is_item:
            held.append((level, ordered, runs))
        else:
            flush()
            out.paragraph(runs)
    flush()
    return words


def _placeholder(shape) -> str | None:
    for e in shape.iter():
        if local(e.tag) == "ph":
            return e.get("type") or "body"
    return None


def _box(shape) -> tuple[int, int, int, int]:
    off, ext = _first(shape, "spPr", "xfrm", "off"), _first(shape, "spPr", "xfrm", "ext")
    return int(_attr(off, "x", 0)), int(_attr(off, "y", 0)), int(_attr(ext, "cx", 0)), int(_attr(ext, "cy", 0))


def _title(shapes: list, height: int) -> tuple[str, object, int] | None:
    """Text, shape and paragraphs taken of a slide's title: a placeholder, else a short large line near the top, else a first line."""
    texts = []
    for s in shapes:
        body = _first(s, "txBody")
        lines = ["".join(r["text"] for r in _slide_runs(p, {})).strip() for p in _kids(body, "p")]
        if any(lines):
            texts.append((s, body, lines))
    for s, _, lines in texts:
        if _placeholder(s) in TITLES:
            return " ".join(x for x in lines if x), s, len(lines)
    found = []
    for s, body, lines in texts:
        points = next((int(v) / 100 for e in body.iter() if local(e.tag) == "rPr" and (v := e.get("sz"))), 0)
        first = next(i for i, x in enumerate(lines) if x)
        text, top = lines[first], _box(s)[1]
        listed = any(bullet(p)[0] for p in _kids(body, "p"))
        if top < TITLE_BAND * height and points >= TITLE_POINTS and len(text) <= TITLE_CHARS and not listed:
            found.append((-points, top, len(found), text, s, first + 1))
    if found:
        return min(found)[3:]
    for s, body, lines in texts:
        first = next(i for i, x in enumerate(lines) if x)
        if len(lines[first]) <= LINE_CHARS and not bullet(_kids(body, "p")[first])[0]:
            return lines[first], s, first + 1
    return None


def parse_pptx(content: bytes, options: dict) -> Outline:
    out = Outline("pptx")
    deck = Archive(content)
    out.metadata = properties(deck)
    root = deck.xml("ppt/presentation.xml")
    relations = deck.relations("ppt/presentation.xml")
    size = _first(root, "sldSz")
    width, height = int(_attr(size, "cx", 0)), int(_attr(size, "cy", 0))
    slides = [relations[_attr_id(s)] for s in _kids(_first(root, "sldIdLst"), "sldId")]
    words = 0
    mode = options.get("images", "extract")
    for number, part in enumerate(slides, 1):
        links = deck.relations(part)
        tree = _first(deck.xml(part), "cSld", "spTree")
        shapes = [e for e in tree.iter() if local(e.tag) in ("sp", "pic", "graphicFrame")]
        texts = [s for s in shapes if local(s.tag) == "sp" and _placeholder(s) not in FOOTERS]
        title = _title(texts, height)
        at, section, path, page = len(out.nodes), out.section, out.path, out.page
        out.page = number
        out.open(2, title[0] if title else f"Slide {number}")
        for s in shapes:
            tag = local(s.tag)
            if tag == "sp" and s in texts:
                words += _frame(out, _first(s, "txBody"), links, title[2] if title and s is title[1] else 0)
            elif tag == "graphicFrame":
                for t in (e for e in s.iter() if local(e.tag) == "tbl"):
                    rows = [[cell(" ".join("".join(r["text"] for r in _slide_runs(p, links)) for p in _kids(_first(tc, "txBody"), "p")).strip(), header=i == 0) for tc in _kids(tr, "tc")] for i, tr in enumerate(_kids(t, "tr"))]
                    out.table(capped(rows, options.get("max_table_rows", MAX_TABLE_ROWS))[0])
            elif tag == "pic":
                props = next((e for e in s.iter() if local(e.tag) == "cNvPr"), None)
                name, alt = _attr(props, "name", ""), (_attr(props, "descr") or "").strip() or (_attr(props, "name") or "").strip()
                _, _, w, h = _box(s)
                bleed = width and height and 0.85 <= w / width <= 1.05 and 0.85 <= h / height <= 1.05
                thin = h > 0 and (w / h > 15 or w / h < 0.067)
                tiny = width and height and w < width * 0.05 and h < height * 0.05
                if bleed or thin or tiny or any(name.lower().startswith(x) for x in SLIDE_NAMES):
                    out.metadata["decorative_images"] = out.metadata.get("decorative_images", 0) + 1
                elif mode != "suppress":
                    out.image("unknown", links.get(next((_attr(b, "embed") for b in s.iter() if local(b.tag) == "blip"), None)), alt or None)
        notes = next((t for t in links.values() if "notesSlide" in t), None)
        if notes and (n := deck.xml(notes)) is not None:
            for s in (e for e in n.iter() if local(e.tag) == "sp" and _placeholder(e) == "body"):
                text = "\n".join(x for p in _kids(_first(s, "txBody"), "p") if (x := "".join(r["text"] for r in _slide_runs(p, {})).strip()))
                if text:
                    out.quote = len(out.nodes)
                    out.paragraph(text)
                    out.quote = None
                    words += len(text.split())
        if not title and len(out.nodes) == at + 1:  # nothing but a made-up title
            del out.nodes[at:]
            out.section, out.path = section, path
        out.page = None
    out.metadata |= {"slide_count": len(slides), "word_count": words or None}
    return out


def _attr_id(e) -> str:
    """The relation that an element names; its own number is called id too, without a name space."""
    return next(v for k, v in e.attrib.items() if local(k) == "id" and k.startswith("{"))

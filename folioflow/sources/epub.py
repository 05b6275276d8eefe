"""EPUB books: the pages of the spine, one after another."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from folioflow.sources import html
from folioflow.sources.archives import Archive
from folioflow.sources.markup import local, parse_html
from folioflow.sources.nodes import Outline


def package_path(book: Archive) -> str | None:
    root = book.xml("META-INF/container.xml")
    if root is not None:
        for e in root.iter():
            if local(e.tag) == "rootfile" and e.get("full-path"):
                return e.get("full-path")
    return next((n for n in sorted(book.names) if n.endswith(".opf")), None)


def spine(book: Archive, package: str) -> tuple[dict, list[str]]:
    """Metadata and the pages' names in reading order; references without a manifest entry fall out."""
    root = book.xml(package)
    folder = posixpath.dirname(package)
    manifest, order, meta = {}, [], {}
    names = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "date": "created_at"}
    for e in root.iter():
        tag = local(e.tag)
        if tag == "item":
            manifest[e.get("id")] = posixpath.normpath(posixpath.join(folder, unquote(e.get("href") or "")))
        elif tag == "itemref":
            order.append(e.get("idref"))
        elif tag in names and (e.text or "").strip():
            meta.setdefault(names[tag], e.text.strip())
    return meta, [manifest[i] for i in order if i in manifest]


def parse(content: bytes, options: dict) -> Outline:
    out = Outline("epub")
    book = Archive(content, options.get("max_unpacked", 500 * 1024 * 1024))
    package = package_path(book)
    if package is None or book.read(package) is None:
        out.warn("content_extracted", "The book has no package file.")
        return out
    out.metadata, pages = spine(book, package)
    words = 0
    for name in pages:
        raw = book.read(name)
        if raw is None:
            continue
        text = raw.decode("utf-8", "replace")
        words += html.page_words(text) or 0
        if out.nodes:
            out.open(1, None)
        html.walk(parse_html(text), out)
    out.metadata["word_count"] = words or None
    return out

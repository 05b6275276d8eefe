"""What parsers write: a document's metadata, warnings and nodes in reading order."""

from __future__ import annotations

from dataclasses import dataclass, field


def run(text, bold=False, italic=False, code=False, strike=False, href=None) -> dict:
    return {"text": text, "bold": bold, "italic": italic, "code": code, "strike": strike, "href": href}


def cell(text="", header=False, parts=None, colspan=1, rowspan=1, **marks) -> dict:
    return {"parts": parts if parts is not None else [[run(str(text), **marks)]], "colspan": colspan, "rowspan": rowspan, "header": header}


def table(rows, caption=None, truncated=False, total_rows=None, merged=False, complex=False) -> dict:
    return {"caption": caption, "truncated": truncated, "total_rows": total_rows, "merged": merged, "complex": complex, "rows": rows}


def markdown_of(runs: list[dict]) -> str:
    """Runs as Markdown, as the renderer shows them."""
    out = ""
    for r in runs:
        text = r["text"].replace("|", "\\|")
        if r["code"]:
            text = f"`{text}`"
        else:
            stars = "*" * (2 * r["bold"] + r["italic"])
            text = f"{stars}{text}{stars}"
            text = f"~~{text}~~" if r["strike"] else text
        out += f"[{text}]({r['href']})" if r["href"] else text
    return out


@dataclass
class Outline:
    """Collects nodes; ``open`` begins a section, everything else goes to the open one."""

    source_format: str
    metadata: dict = field(default_factory=dict)
    nodes: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    outcome: str = "success"
    section: int = 0
    path: tuple[str, ...] = ()
    page: int | None = None
    quote: int | None = None

    def _add(self, kind: str, **fields) -> None:
        blank = dict.fromkeys(("level", "page", "quote", "runs", "table", "items", "code", "language", "image"))
        self.nodes.append(blank | {"node_id": len(self.nodes), "section": self.section, "type": kind, "path": list(self.path), "page": self.page, "quote": self.quote} | fields)

    def open(self, level: int, runs: list[dict] | str | None, under: tuple[str, ...] = ()) -> tuple[str, ...]:
        """Begin a section below the path ``under``; without runs it has no heading. Returns its path."""
        if isinstance(runs, str):
            runs = [run(runs)]
        if self.nodes or self.section:
            self.section += 1
        text = markdown_of(runs or [])
        self.path = (*under, text) if text else under
        if runs:
            self._add("heading", level=level, runs=runs)
        return self.path

    def paragraph(self, runs: list[dict] | str, **marks) -> None:
        self._add("paragraph", runs=[run(runs, **marks)] if isinstance(runs, str) else runs)

    def table(self, rows, **flags) -> None:
        self._add("table", table=table(rows, **flags))

    def items(self, items: list[dict]) -> None:
        self._add("list", items=items)

    def code(self, text: str, language: str | None = None) -> None:
        self._add("code", code=text, language=language)

    def image(self, kind="unknown", path=None, alt=None, caption=None, ocr=None) -> None:
        self._add("image", image={"kind": kind, "path": path, "alt": alt, "caption": caption, "ocr": ocr})

    def warn(self, kind: str, message: str, pages=None, count=None) -> None:
        self.warnings.append({"type": kind, "message": message, "pages": pages, "count": count})

    def row(self) -> dict:
        blank = dict.fromkeys(("title", "author", "subject", "description", "created_at", "modified_at", "page_count", "slide_count", "sheet_count", "word_count", "decorative_images"))
        return {"outcome": self.outcome, "metadata": blank | {"keywords": []} | self.metadata | {"source_format": self.source_format}, "warnings": self.warnings, "notes": self.notes, "nodes": self.nodes}


def flat_items(entries: list[tuple[int, bool, list[dict]]]) -> list[dict]:
    """Items of (depth, ordered, runs) with their numbers within their own lists."""
    counts: list[int] = []
    out = []
    for depth, ordered, runs in entries:
        counts = counts[: depth + 1] + [0] * (depth + 1 - len(counts))
        counts[depth] += 1
        out.append({"depth": depth, "ordered": ordered, "ord": counts[depth], "runs": runs})
    return out


def capped(rows: list, most: int, heads: int = 1) -> tuple[list, bool, int | None]:
    """Rows cut to ``most``, whether they were, and how many there had been. Zero sets no cap."""
    cut = 0 < most < len(rows)
    return (rows[:most] if cut else rows), cut, (len(rows) if cut else None)

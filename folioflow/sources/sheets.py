"""Spreadsheets and CSV files as outlines, a section per sheet."""

from __future__ import annotations

import csv
import io
import re
from datetime import datetime, timedelta

from folioflow.schema import MAX_TABLE_ROWS
from folioflow.sources.archives import Archive, properties
from folioflow.sources.markup import local
from folioflow.sources.nodes import Outline, capped, cell

_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_REF = re.compile(r"([A-Z]+)(\d+)")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(e) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")


def _date_styles(book: Archive) -> set[int]:
    root = book.xml("xl/styles.xml")
    if root is None:
        return set()
    own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if local(e.tag) == "numFmt"}
    is_date = lambda i: i in _DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")), re.I))
    for e in root.iter():
        if local(e.tag) == "cellXfs":
            return {i for i, xf in enumerate(e) if is_date(int(xf.get("numFmtId") or 0))}
    return set()


def _number(raw: str):
    value = float(raw)
    return int(value) if value.is_integer() and "." not in raw and "e" not in raw.lower() else value


def sheet_values(book: Archive, part: str, shared: list[str], dates: set[int]) -> tuple[dict, list, dict]:
    """Values by (row, column), merged regions, and formulas by place."""
    values, merges, formulas = {}, [], {}
    for e in book.xml(part).iter():
        tag = local(e.tag)
        if tag == "mergeCell":
            a, _, b = (e.get("ref") or "").partition(":")
            (c0, r0), (c1, r1) = _REF.match(a).groups(), _REF.match(b or a).groups()
            merges.append((int(r0) - 1, column_number(c0), int(r1) - 1, column_number(c1)))
        elif tag == "c" and (m := _REF.match(e.get("r") or "")):
            at = int(m[2]) - 1, column_number(m[1])
            kind = e.get("t")
            raw = next((c.text for c in e if local(c.tag) == "v"), None)
            if (f := next((c for c in e if local(c.tag) == "f"), None)) is not None:
                formulas[at] = "=" + (f.text or "")
            if kind == "inlineStr":
                values[at] = _texts(e)
            elif raw is not None:
                if kind == "s":
                    values[at] = shared[int(raw)]
                elif kind == "b":
                    values[at] = raw == "1"
                elif kind in ("str", "e"):
                    values[at] = raw
                elif int(e.get("s") or 0) in dates:
                    values[at] = datetime(1899, 12, 30) + timedelta(seconds=round(float(raw) * 86400))
                else:
                    values[at] = _number(raw)
    return values, merges, formulas


def shown(value, header: bool) -> str:
    if value is None:
        return ""
    if header and isinstance(value, datetime):
        first = value.day == 1 and (value.hour, value.minute, value.second) == (0, 0, 0)
        return value.strftime("%b %Y" if first else "%Y-%m-%d")
    text = str(value)
    return f"[formula: {text}]" if isinstance(value, str) and text.startswith("=") else text


def trimmed(grid: list[list[str]]) -> list[list[str]]:
    """Without empty rows at the end and then blank columns at the right."""
    while grid and all(v == "" for v in grid[-1]):
        grid = grid[:-1]
    width = max((i + 1 for row in grid for i, v in enumerate(row) if v.strip()), default=0)
    return [row[:width] for row in grid] if width else []


def _write(out: Outline, grid: list[list[str]], most: int) -> None:
    rows, cut, total = capped(grid, most)
    if cut:
        out.warn("table_truncated", f"Table truncated from {total} to {most} rows.", count=total)
    out.table([[cell(v, header=i == 0) for v in row] for i, row in enumerate(rows)], truncated=cut, total_rows=total)


def parse_xlsx(content: bytes, options: dict) -> Outline:
    macros = options.get("extension") == ".xlsm"
    out = Outline("xlsm" if macros else "xlsx")
    book = Archive(content)
    out.metadata = properties(book)
    relations = book.relations("xl/workbook.xml")
    root = book.xml("xl/sharedStrings.xml")
    shared = [] if root is None else [_texts(e) for e in root]
    dates = _date_styles(book)
    most = options.get("max_table_rows", MAX_TABLE_ROWS)
    sheets = [e for e in book.xml("xl/workbook.xml").iter() if local(e.tag) == "sheet"]
    words = 0
    for sheet in sheets:
        name = sheet.get("name") or ""
        rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
        values, merges, formulas = sheet_values(book, relations[rid], shared, dates)
        if formulas and not any(at in values for at in formulas):
            out.notes.append(f"Sheet '{name}': formulas have no cached values.")
        for r0, c0, r1, c1 in merges:
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    values[r, c] = values.get((r0, c0))
        rows, cols = (max((at[i] for at in values), default=-1) + 1 for i in (0, 1))
        grid = trimmed([[shown(values.get((r, c)), r == 0) for c in range(cols)] for r in range(rows)])
        if not grid:
            out.notes.append(f"Sheet '{name}' is empty.")
            continue
        out.open(2, name)
        _write(out, grid, most)
        words += sum(len(v.split()) for row in (grid[:most] if most else grid) for v in row)
    if macros:
        out.notes.append("Macros are not converted.")
    out.metadata |= {"sheet_count": len(sheets), "word_count": words or None}
    return out


def parse_csv(content: bytes, options: dict) -> Outline:
    out = Outline("csv")
    grid = [list(r) for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))]
    width = max(map(len, grid), default=0)
    grid = trimmed([r + [""] * (width - len(r)) for r in grid])
    if grid:
        _write(out, grid, options.get("max_table_rows", MAX_TABLE_ROWS))
    return out

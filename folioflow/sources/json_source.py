"""JSON documents as outlines: schemas, arrays of records, flat objects, and code for the rest."""

from __future__ import annotations

import json

from folioflow.schema import MAX_TABLE_ROWS
from folioflow.sources.nodes import Outline, cell

SCALARS = (str, int, float, bool, type(None))


def kind_of(data) -> str:
    """``schema``, ``flat_object``, ``array_dump`` or ``code``."""
    if isinstance(data, dict):
        if "$schema" in data or "$defs" in data or "definitions" in data or ("properties" in data and "type" in data):
            return "schema"
        if data and all(isinstance(v, SCALARS) for v in data.values()):
            return "flat_object"
    if isinstance(data, list) and data and all(isinstance(x, dict) for x in data):
        return "array_dump"
    return "code"


def words_in(data) -> int:
    """Words of all texts; keys don't count."""
    if isinstance(data, str):
        return len(data.split())
    inner = data.values() if isinstance(data, dict) else data if isinstance(data, list) else ()
    return sum(map(words_in, inner))


def type_label(schema) -> str:
    """What a property holds, in a word or two."""
    match schema:
        case {"type": [*kinds]}:
            return " | ".join(map(str, kinds))
        case {"type": "array", "items": dict() as inner}:
            return f"array<{type_label(inner)}>"
        case {"type": kind} if kind:
            return str(kind)
        case dict():
            return "object"
    return str(schema)


def _pretty(data) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False)


def _heads(*names: str) -> list[dict]:
    return [cell(n, header=True) for n in names]


def _properties(out: Outline, schema: dict) -> None:
    required = set(schema.get("required", []))
    rows = [_heads("Name", "Type", "Required", "Description")]
    for name, own in schema["properties"].items():
        own = own if isinstance(own, dict) else {}
        rows.append([cell(name), cell(type_label(own)), cell("yes" if name in required else "no"), cell(own.get("description", ""))])
    out.table(rows)


def _has_properties(schema) -> bool:
    return isinstance(schema.get("properties"), dict) and bool(schema["properties"])


def _schema(out: Outline, data: dict) -> None:
    out.metadata["title"], out.metadata["description"] = data.get("title"), data.get("description")
    if _has_properties(data):
        out.open(1, "Properties")
        _properties(out, data)
    inner = data.get("$defs") or data.get("definitions")
    inner = {k: v for k, v in inner.items() if isinstance(v, dict)} if isinstance(inner, dict) else {}
    if inner:
        top = out.open(1, "Definitions")
        for name, own in inner.items():
            out.open(2, name, top)
            if _has_properties(own):
                if own.get("description"):
                    out.paragraph(own["description"])
                _properties(out, own)
            else:
                out.code(_pretty(own), "json")
    if not out.nodes:
        out.code(_pretty(data), "json")


def _records(out: Outline, data: list[dict], most: int) -> None:
    heads = list(dict.fromkeys(k for row in data for k in row))
    cut = 0 < most < len(data)
    if cut:
        out.warn("table_truncated", f"Array table truncated from {len(data)} to {most} rows.", count=len(data))
    rows = [_heads(*heads)] + [[cell(str(row.get(h, ""))) for h in heads] for row in (data[:most] if cut else data)]
    out.table(rows, truncated=cut, total_rows=len(data) if cut else None)


def parse(content: bytes, options: dict) -> Outline:
    out = Outline("json")
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    try:
        data = json.loads(text)
    except ValueError as e:
        out.warn("content_extracted", f"Invalid JSON: {e}")
        return out
    kind = kind_of(data)
    if kind == "schema":
        _schema(out, data)
    elif kind == "array_dump":
        _records(out, data, options.get("max_table_rows", MAX_TABLE_ROWS))
    elif kind == "flat_object":
        out.table([_heads("Key", "Value")] + [[cell(k), cell("" if v is None else str(v))] for k, v in data.items()])
    else:
        out.code(_pretty(data), "json")
    out.metadata["word_count"] = words_in(data) or None
    return out

"""WSDL 1.1 and 2.0 service descriptions as outlines."""

from __future__ import annotations

from xml.etree.ElementTree import Element, ParseError

from folioflow.sources.markup import RefusedXml, local, parse_xml
from folioflow.sources.nodes import Outline, cell

DASH = "—"


def _name(e: Element, attr: str = "name") -> str:
    return (e.get(attr) or "").strip()


def _short(qname: str) -> str:
    return qname.split(":", 1)[1] if ":" in qname else qname


def _under(e: Element, *tags: str) -> list[Element]:
    return [c for c in e if local(c.tag) in tags]


def _said(e: Element) -> str:
    for d in _under(e, "documentation"):
        return " ".join("".join(d.itertext()).split())
    return ""


def _fields(e: Element) -> list[tuple[str, str]]:
    """Name and type of the elements and attributes below, however deep."""
    out = []
    for c in e:
        tag = local(c.tag)
        if tag in ("element", "attribute") and (_name(c) or _name(c, "ref")):
            kind = _short(_name(c, "type")) or (DASH if not _name(c, "ref") else _short(_name(c, "ref")))
            out.append((_name(c) or _short(_name(c, "ref")), kind))
        if tag != "annotation":
            out += _fields(c)
    return out


def _pairs(out: Outline, heads: tuple[str, str], rows) -> None:
    out.table([[cell(h, header=True) for h in heads], *[[cell(a or DASH), cell(b or DASH)] for a, b in rows]])


def _types(out: Outline, root: Element) -> None:
    named = []
    for types in _under(root, "types"):
        for schema in _under(types, "schema"):
            for e in _under(schema, "complexType", "simpleType", "element"):
                if not _name(e):
                    continue
                fields = _fields(e)
                if not fields and local(e.tag) == "element":
                    fields = [(_name(e), _short(_name(e, "type")) or DASH)]
                for r in (r for r in e.iter() if local(r.tag) == "restriction"):
                    if not fields:
                        fields = [(_name(e), _short(_name(r, "base")) or DASH)]
                said = [" ".join("".join(d.itertext()).split()) for a in _under(e, "annotation") for d in _under(a, "documentation")]
                named.append((_name(e), " ".join(t for t in said if t), fields))
    if named:
        top = out.open(1, "Types")
        for name, said, fields in named:
            out.open(2, name, top)
            if said:
                out.paragraph(said)
            if fields:
                _pairs(out, ("Field", "Type"), fields)


def _messages(out: Outline, root: Element) -> dict[str, list[tuple[str, str]]]:
    made = {}
    for m in _under(root, "message"):
        made[_name(m)] = [(_name(p), _short(_name(p, "type") or _name(p, "element"))) for p in _under(m, "part")]
    if made:
        top = out.open(1, "Messages")
        for name, parts in made.items():
            out.open(2, name, top)
            if parts:
                _pairs(out, ("Part Name", "Type"), parts)
    return made


def _operations(out: Outline, home: Element, kind: str, messages: dict[str, list], ref: str) -> None:
    top = out.open(1, f"{kind}: {_name(home)}")
    if text := _said(home):
        out.paragraph(text)
    for op in _under(home, "operation"):
        out.open(2, f"Operation: {_name(op)}", top)
        if text := _said(op):
            out.paragraph(text)
        for way in ("input", "output", "fault", "infault", "outfault"):
            for e in _under(op, way):
                target = _short(_name(e, ref) or _name(e, "ref"))
                if target:
                    out.paragraph(f"{'Fault' if 'fault' in way else way.capitalize()}: {target}")
                    if way in ("input", "output") and messages.get(target):  # the message by its local name
                        _pairs(out, ("Part Name", "Type"), messages[target])


def _bindings(out: Outline, root: Element, attr: str, ref: str) -> None:
    for b in _under(root, "binding"):
        of = _short(_name(b, attr))
        out.open(1, f"Binding: {_name(b)}" + (f" ({attr}: {of})" if of else ""))
        if text := _said(b):
            out.paragraph(text)
        for op in _under(b, "operation"):
            if name := _short(_name(op, ref)):
                out.paragraph(f"Operation: {name}")


def _services(out: Outline, root: Element, port: str, attr: str | None) -> None:
    for s in _under(root, "service"):
        of = _short(_name(s, attr)) if attr else ""
        out.open(1, f"Service: {_name(s)}" + (f" ({attr}: {of})" if of else ""))
        if text := _said(s):
            out.paragraph(text)
        for p in _under(s, port):
            where = next((_name(a, "location") for a in _under(p, "address")), _name(p, "address"))
            shown = [f"{port.capitalize()}: {_name(p)}" if _name(p) else "", f"Binding: {_short(_name(p, 'binding'))}" if _name(p, "binding") else "", f"Address: {where}" if where else ""]
            if any(shown):
                out.paragraph(f" {DASH} ".join(x for x in shown if x))


def parse(content: bytes, options: dict) -> Outline:
    out = Outline("wsdl")
    try:
        root = parse_xml(content)
    except (ParseError, RefusedXml, ValueError) as e:
        out.warn("content_extracted", f"Invalid WSDL: {e}")
        return out
    out.metadata["title"] = _name(root) or _name(root, "targetNamespace") or None
    if text := _said(root):
        out.open(1, "Documentation")
        out.paragraph(text)
    _types(out, root)
    if local(root.tag) == "description":  # 2.0
        for e in _under(root, "interface"):
            _operations(out, e, "Interface", {}, "element")
        _bindings(out, root, "interface", "ref")
        _services(out, root, "endpoint", "interface")
    else:
        messages = _messages(out, root)
        for e in _under(root, "portType"):
            _operations(out, e, "Port Type", messages, "message")
        _bindings(out, root, "type", "name")
        _services(out, root, "port", None)
    text = " ".join(r["text"] for n in out.nodes for r in n["runs"] or ())
    out.metadata["word_count"] = len(text.split()) or None
    return out

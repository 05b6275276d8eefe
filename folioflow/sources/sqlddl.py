"""SQL scripts as documentation of the tables, views, routines and indexes that they create."""

from __future__ import annotations

import re
from dataclasses import dataclass

from folioflow.sources.nodes import Outline, cell

#: Words that begin a table's constraint, and words that end a column's type.
CONSTRAINT_WORDS = ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK", "CONSTRAINT", "INDEX", "KEY")
TYPE_ENDS = frozenset("NOT NULL DEFAULT PRIMARY REFERENCES UNIQUE CHECK AUTO_INCREMENT AUTOINCREMENT IDENTITY GENERATED".split())

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$\$.*?\$\$|\bBEGIN\b|\bCASE\b|\bEND\b|[(),;]""", re.S | re.I)
_LEX = re.compile(r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]\n]*\])|(?P<text>'(?:[^']|'')*')|(?P<word>\w+)|(?P<sign>.)""", re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    depth: int  # open parentheses before it

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    @property
    def name(self) -> str:
        return self.text[1:-1] if self.kind == "quoted" else self.text


def lex(sql: str) -> list[Token]:
    """The tokens of a statement, without space and comments."""
    out, depth = [], 0
    for m in _LEX.finditer(sql):
        if m.lastgroup == "skip":
            continue
        if m[0] == ")":
            depth -= 1
        out.append(Token(m.lastgroup, m[0], m.start(), m.end(), depth))
        if m[0] == "(":
            depth += 1
    return out


def statements(text: str) -> list[str]:
    """Statements without their last semicolon; quotes, comments, dollar bodies and BEGIN blocks hold theirs."""
    out, start, depth = [], 0, 0
    for m in _TOKEN.finditer(text):
        word = m[0].upper()
        if word in ("BEGIN", "CASE"):
            rest = text[m.end() : m.end() + 20].lstrip()
            depth += not (word == "BEGIN" and rest.startswith(";"))
        elif word == "END":
            depth = max(0, depth - 1)
        elif word == ";" and depth == 0:
            out.append(text[start : m.start()])
            start = m.end()
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


def without_comments(text: str) -> str:
    return re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", text, flags=re.S)).strip()


def leading_comment(text: str) -> str:
    """The text of the ``--`` lines that open a statement."""
    own = []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("--"):
            own.append(line.lstrip("-").strip())
        elif line:
            break
    return " ".join(x for x in own if x)


def qualified_name(tokens: list[Token], at: int) -> tuple[str, int]:
    """A name, maybe with its schema, and where it ends."""
    name, at = tokens[at].name, at + 1
    while at + 1 < len(tokens) and tokens[at].text == "." and tokens[at + 1].kind in ("word", "quoted"):
        name, at = f"{name}.{tokens[at + 1].name}", at + 2
    return name, at


def created(tokens: list[Token]) -> tuple[str, str, int] | None:
    """What a statement creates, its name, and where the name ends; None for other statements."""
    words = [t.upper for t in tokens]
    if words[:1] != ["CREATE"]:
        return None
    kinds = ("TABLE", "VIEW", "PROCEDURE", "FUNCTION", "INDEX")
    at = next((i for i, w in enumerate(words[1:6], 1) if w in kinds), None)
    if at is None:
        return None
    kind, at = words[at], at + 1
    if words[at : at + 3] == ["IF", "NOT", "EXISTS"]:
        at += 3
    if at >= len(tokens) or tokens[at].kind not in ("word", "quoted"):
        return None
    return (kind, *qualified_name(tokens, at))


def _column(sql: str, own: list[Token]) -> dict:
    """Name, type and marks of a column's tokens, the first of which is its name."""
    top = own[0].depth
    ends = next((i for i, t in enumerate(own[1:], 1) if t.depth == top and t.upper in TYPE_ENDS), len(own))
    kind = sql[own[1].start : own[ends - 1].end] if ends > 1 else ""
    rest = [t for t in own[ends:]]
    words = [t.upper for t in rest if t.depth == top]
    pairs = list(zip(words, words[1:], strict=False))
    default = None
    for i, t in enumerate(rest[:-1]):
        if t.upper == "DEFAULT" and t.depth == top:
            last = rest[i + 1]
            for u in rest[i + 2 :]:  # a value goes on while it is in parentheses, or is called
                if u.depth > top or u.text == ")" or (u.text == "(" and u.start == last.end):
                    last = u
                else:
                    break
            default = sql[rest[i + 1].start : last.end]
            break
    return {"name": own[0].name, "type": " ".join(kind.split()).upper(), "not_null": ("NOT", "NULL") in pairs, "default": default, "pk": ("PRIMARY", "KEY") in pairs}


def table_definition(sql: str) -> dict | None:
    """Name, columns and constraints of a CREATE TABLE, or None.

    A part that begins with a constraint's words is a constraint; whole words count, so a column may be called ``key_id``."""
    tokens = lex(sql)
    made = created(tokens)
    if made is None or made[0] != "TABLE":
        return None
    opens = next((i for i in range(made[2], len(tokens)) if tokens[i].text == "("), None)
    if opens is None:
        return None
    body, parts = [t for t in tokens[opens + 1 :] if t.depth > 0], [[]]
    for t in body:
        if t.text == "," and t.depth == 1:
            parts.append([])
        else:
            parts[-1].append(t)
    columns, constraints = [], []
    for own in filter(None, parts):
        lead = " ".join(t.upper for t in own[:2])
        if any(lead == c or lead.split(" ")[0] == c for c in CONSTRAINT_WORDS):
            constraints.append(" ".join(without_comments(sql[own[0].start : own[-1].end]).split()))
        elif len(own) > 1 and own[0].kind in ("word", "quoted"):
            columns.append(_column(sql, own))
    return {"name": made[1], "columns": columns, "constraints": constraints}


def _table(out: Outline, made: dict) -> None:
    rows = [[cell(h, header=True, bold=True) for h in ("Column", "Type", "NOT NULL", "Default", "PK")]]
    for c in made["columns"]:
        rows.append([cell(c["name"], code=True), cell(c["type"]), cell("YES" if c["not_null"] else ""), cell(c["default"] or ""), cell("YES" if c["pk"] else "")])
    out.table(rows)
    for c in made["constraints"]:
        out.paragraph(c, bold=True)


def parse(content: bytes, options: dict) -> Outline:
    text = content.decode("utf-8", "replace")
    out = Outline("sql")
    plan: list[dict] = []  # sections in order; an index joins a table seen before it
    tables: dict[str, dict] = {}
    words = 0
    for raw in statements(text):
        comment, body = leading_comment(raw), re.sub(r"\A(?:\s*--[^\n]*\n?)+", "", raw).strip()
        bare = without_comments(body)
        words += len(comment.split())
        if not bare:
            continue
        own = {"heading": None, "level": 1, "comment": comment, "code": body, "table": None, "under": []}
        tokens = lex(body)
        kind, name, at = created(tokens) or (None, "", 0)
        if kind == "TABLE" or (kind is None and bare.upper().startswith("CREATE TABLE")):
            made = table_definition(body)
            if made is None:
                out.warn("content_extracted", "CREATE TABLE structure extraction failed; rendered as raw code block.")
            else:
                own |= {"heading": f"Table: {made['name']}", "table": made}
                tables[made["name"].upper()] = own
                words += len(made["name"].split()) + len(made["columns"])
        elif kind == "INDEX":
            own["heading"] = f"Index: {name}"
            if at + 1 < len(tokens) and tokens[at].upper == "ON":
                home = tables.get(qualified_name(tokens, at + 1)[0].upper())
                if home is not None:
                    own["level"] = 2
                    home["under"].append(own)
                    continue
        elif kind:
            own["heading"] = f"{kind.capitalize()}: {name}"
        plan.append(own)

    def write(own: dict, under: tuple[str, ...]) -> None:
        path = out.open(own["level"], own["heading"], under)
        if own["comment"]:
            out.paragraph(own["comment"])
        if own["table"]:
            _table(out, own["table"])
        else:
            out.code(own["code"], "sql")
        for sub in own["under"]:
            write(sub, path)

    for own in plan:
        write(own, ())
    out.metadata["word_count"] = words or None
    return out

"""Parsers and the scan."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.plans import render
from folioflow.plans.catalog_formats import _zipped, book, workbook
from folioflow.plans.convert import Options, convert, convert_stream, convert_to_nodes, results
from folioflow.sources import html, json_source, office, sheets, sqlddl, wsdl
from folioflow.sources.archives import Archive, RefusedArchive
from folioflow.sources.nodes import Outline
from folioflow.sources.registry import Format, Registry, documents_of, nodes_of, parse_sources, registry, scan


def kinds(out):
    return [n["type"] for n in out.nodes]


def text(node):
    return "".join(r["text"] for r in node["runs"])


def grid(node):
    return [["".join(r["text"] for p in c["parts"] for r in p) for c in row] for row in node["table"]["rows"]]


def test_headings_and_blocks():
    out = html.parse(b"<html><head><title>T</title></head><body>loose<!-- c --><p>pre</p><h1>H1</h1><h6>H6</h6><div>loose<p>in <b>bold <i>both</i></b></p></div><span>odd</span><pre>code</pre><img alt='pic'><script>x</script></body></html>", {})
    assert kinds(out) == ["paragraph", "heading", "heading", "paragraph", "paragraph", "code", "image"]
    assert [n["level"] for n in out.nodes if n["type"] == "heading"] == [1, 6] and out.metadata["title"] == "T"
    assert out.nodes[0]["section"] == 0 and out.nodes[1]["section"] == 1 and out.nodes[3]["path"] == ["H6"]
    assert [(r["text"], r["bold"], r["italic"]) for r in out.nodes[3]["runs"]] == [("in ", False, False), ("bold ", True, False), ("both", True, True)]


def test_lists_nest_to_three_levels():
    out = html.parse(b"<ul><li>a<ol><li>b<ul><li>c<ul><li>d</li></ul></li></ul></li></ol></li><li>e</ul>", {})
    assert [(i["depth"], i["ordered"], i["ord"]) for i in out.nodes[0]["items"]] == [(0, False, 1), (1, True, 1), (2, False, 1), (0, False, 2)]


def test_tables_have_a_header():
    out = html.parse(b"<table><thead><tr><th>h<tbody><tr><td>1<td>2</table><table><tr><td>x</td></tr><tr><td>y</td></tr></table>", {})
    assert grid(out.nodes[0]) == [["h"], ["1", "2"]]
    assert [[c["header"] for c in row] for row in out.nodes[1]["table"]["rows"]] == [[True], [False]]


@pytest.mark.parametrize("page", [b"", b"<", b"<p", b"</p></p>", b"<p>a<p>b<ul><li>c", b"\xff\xfe<b>", b"<custom>x</custom>", b"<table><li></table>"])
def test_nothing_makes_a_page_fail(page):
    html.parse(page, {})
    html.parse(page, {"extract_content": True})


def test_main_content():
    page = b"<body><nav><p>menu</p></nav><article><p>story</p><div><a href=x>link link link</a></div></article><footer><p>f</p></footer></body>"
    assert [text(n) for n in html.parse(page, {"extract_content": True}).nodes] == ["story"]


def test_json_documents():
    rows = json_source.parse(json.dumps([{"a": 1, "b": None}, {"c": [1], "a": True}, {"a": 1.0}]).encode(), {"max_table_rows": 2})
    assert grid(rows.nodes[0]) == [["a", "b", "c"], ["1", "None", ""], ["True", "", "[1]"]]
    assert rows.nodes[0]["table"]["total_rows"] == 3 and rows.warnings[0]["type"] == "table_truncated" and rows.warnings[0]["count"] == 3
    flat = json_source.parse(b'{"a": null, "b": "two words"}', {})
    assert grid(flat.nodes[0]) == [["Key", "Value"], ["a", ""], ["b", "two words"]] and flat.metadata["word_count"] == 2
    schema = {"title": "S", "properties": {"id": {"type": "integer", "description": "d"}, "tags": {"type": "array", "items": {"type": ["string", "null"]}}, "x": 3}, "type": "object", "required": ["id"], "$defs": {"A": {"properties": {"q": {}}, "description": "about"}, "B": {"enum": [1]}}}
    made = json_source.parse(json.dumps(schema).encode(), {})
    assert grid(made.nodes[1]) == [["Name", "Type", "Required", "Description"], ["id", "integer", "yes", "d"], ["tags", "array<string | null>", "no", ""], ["x", "object", "no", ""]]
    assert [n["path"] for n in made.nodes if n["type"] == "heading"] == [["Properties"], ["Definitions"], ["Definitions", "A"], ["Definitions", "B"]] and kinds(made)[-1] == "code"
    assert json_source.parse(b"{", {}).warnings[0]["type"] == "content_extracted" and not json_source.parse(b"{", {}).nodes
    assert kinds(json_source.parse(b"[]", {})) == ["code"]


def test_sql_scripts():
    out = sqlddl.parse(b"""
-- people
CREATE TABLE IF NOT EXISTS `people` (id INT NOT NULL PRIMARY KEY, key_id int, name VARCHAR(10) DEFAULT 'a;b', price decimal(10, 2) NOT NULL DEFAULT (1+1),
  PRIMARY KEY (id, name), CONSTRAINT c CHECK (id > 0));
CREATE INDEX early ON later (x);
CREATE UNIQUE INDEX i ON people (name);
CREATE OR REPLACE VIEW v AS SELECT 1; CREATE FUNCTION f() RETURNS int BEGIN SELECT 1; END;
INSERT INTO people VALUES (1);
""", {})
    heads = [(text(n), n["level"], n["path"]) for n in out.nodes if n["type"] == "heading"]
    assert heads == [("Table: people", 1, ["Table: people"]), ("Index: i", 2, ["Table: people", "Index: i"]), ("Index: early", 1, ["Index: early"]), ("View: v", 1, ["View: v"]), ("Function: f", 1, ["Function: f"])]
    assert grid(out.nodes[2]) == [["Column", "Type", "NOT NULL", "Default", "PK"], ["id", "INT", "YES", "", "YES"], ["key_id", "INT", "", "", ""], ["name", "VARCHAR(10)", "", "'a;b'", ""], ["price", "DECIMAL(10, 2)", "YES", "(1+1)", ""]]
    assert text(out.nodes[1]) == "people" and [text(n) for n in out.nodes[3:5]] == ["PRIMARY KEY (id, name)", "CONSTRAINT c CHECK (id > 0)"]
    assert "SELECT 1; END" in next(n["code"] for n in out.nodes if n["path"] == ["Function: f"] and n["code"]) and out.nodes[-1]["code"].startswith("INSERT")


def test_wsdl():
    two = b'<description xmlns="http://www.w3.org/ns/wsdl" targetNamespace="urn:x"><interface name="I"><operation name="O"><input element="t:E"/></operation></interface><service name="S" interface="t:I"><endpoint name="P" binding="t:B" address="http://x"/></service></description>'
    out = wsdl.parse(two, {})
    assert [text(n) for n in out.nodes] == ["Interface: I", "Operation: O", "Input: E", "Service: S (interface: I)", "Endpoint: P — Binding: B — Address: http://x"]
    assert wsdl.parse(b"<a", {}).warnings and wsdl.parse(b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", {}).warnings


def test_spreadsheets():
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = f'<sheetData><row r="1">{cell("A1", "A")}{cell("B1", "B")}{cell("E1", " ")}</row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><f>A1</f></c></row><row r="3"><c r="A3"><v>2.5</v></c><c r="B3" t="b"><v>1</v></c></row><row r="9">{cell("A9", "")}</row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells>'
    out = sheets.parse_xlsx(workbook({"One": rows, "None": "<sheetData/>"}), {"extension": ".xlsm", "max_table_rows": 3})
    assert grid(out.nodes[1]) == [["A", "B"], ["1", ""], ["2.5", "True"]] and out.nodes[1]["table"]["total_rows"] == 4 and out.metadata["sheet_count"] == 2
    assert out.notes == ["Sheet 'One': formulas have no cached values.", "Sheet 'None' is empty.", "Macros are not converted."] and out.warnings[0]["type"] == "table_truncated"
    flat = sheets.parse_csv("﻿a,b,\n1,\"x, y\",\n\n".encode(), {})
    assert grid(flat.nodes[0]) == [["a", "b"], ["1", "x, y"]]
    assert not sheets.parse_csv(b"", {}).nodes


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_text_documents():
    p = lambda t, style="", num="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{num}</w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>'
    item = lambda d: f'<w:numPr><w:ilvl w:val="{d}"/><w:numId w:val="1"/></w:numPr>'
    body = p("Head", "Heading2") + p("text here") + p("one", num=item(0)) + p("two", num=item(1)) + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + p("c") + "</w:tc></w:tr></w:tbl>"
    doc = _zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>', "docProps/core.xml": '<c:p xmlns:c="x" xmlns:d="y"><d:title>T</d:title><d:creator>A</d:creator><c:keywords>k, l</c:keywords></c:p>'})
    out = office.parse_docx(doc, {})
    assert kinds(out) == ["heading", "paragraph", "list", "table"] and out.nodes[0]["level"] == 2 and out.metadata["title"] == "T" and out.metadata["keywords"] == ["k", "l"] and out.metadata["word_count"] == 5
    assert [i["depth"] for i in out.nodes[2]["items"]] == [0, 1] and out.nodes[3]["table"]["rows"][0][0]["colspan"] == 2


def test_slides():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda ph, paras: f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\"{ph}\"/>" if ph else ""}</p:nvPr></p:nvSpPr><p:txBody>{paras}</p:txBody></p:sp>'
    para = lambda t, pr="": f"<a:p><a:pPr {pr}</a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f'<p:sld {ns}><p:cSld><p:spTree>{sp("title", para("Title", ">"))}{sp("", para("one", "><a:buChar/>") + para("two", "lvl=\"1\">") + para("plain", "><a:buNone/>"))}{sp("ftr", para("foot", ">"))}</p:spTree></p:cSld></p:sld>'
    empty = f'<p:sld {ns}><p:cSld><p:spTree/></p:cSld></p:sld>'
    rel = lambda *t: '<Relationships>' + "".join(f'<Relationship Id="r{i}" Target="{x}"/>' for i, x in enumerate(t, 1)) + "</Relationships>"
    deck = _zipped({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst><p:sldSz cx="9144000" cy="5143500"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rel("slides/s1.xml", "slides/s2.xml"),
        "ppt/slides/s1.xml": slide, "ppt/slides/s2.xml": empty, "ppt/slides/_rels/s1.xml.rels": rel("../notesSlides/notesSlide1.xml"),
        "ppt/notesSlides/notesSlide1.xml": f'<p:notes {ns}><p:cSld><p:spTree>{sp("body", para("note", ">"))}</p:spTree></p:cSld></p:notes>',
    })
    out = office.parse_pptx(deck, {})
    assert kinds(out) == ["heading", "list", "paragraph", "paragraph"] and text(out.nodes[0]) == "Title" and out.nodes[3]["quote"] == 3 and text(out.nodes[3]) == "note"
    assert [i["depth"] for i in out.nodes[1]["items"]] == [0, 1] and out.metadata["slide_count"] == 2


def test_archives_are_guarded():
    with pytest.raises(RefusedArchive):
        Archive(b"no zip")
    with pytest.raises(RefusedArchive):
        Archive(_zipped({"a": "x" * 1000}), most=999)


def test_registry():
    assert registry.find("/a/b.HTML").name == "html" and registry.find("x.xlsm").name == "xlsx"
    with pytest.raises(LookupError):
        registry.find("x.unknown")
    own = Registry()
    own.register(Format("odd", (".odd",), lambda c, o: Outline("odd"), requires=("no_such_module_here",)))
    assert own.skipped() == {"odd": ["no_such_module_here"]} and not own.extensions()
    with pytest.raises(LookupError):
        own.find("a.odd")


def test_bad_files_become_rows(spark):
    given = [("a", "a.xlsx", ".xlsx", bytearray(b"no")), ("b", "b.zzz", ".zzz", bytearray(b"x")), ("c", "c.doc", ".doc", bytearray(b"x")), ("d", None, ".html", None), ("e", "e.html", ".html", bytearray(b"<p>ok"))]
    parsed = parse_sources(spark.createDataFrame(given, "doc_id string, source string, ext string, content binary"))
    got = {r.doc_id: r for r in documents_of(parsed).collect()}
    assert [got[k].outcome for k in "abcde"] == ["parse_error"] * 4 + ["success"] and "RefusedArchive" in got["a"].notes[0]
    assert [r.doc_id for r in nodes_of(parsed).collect()] == ["e"]


def test_conversion(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>A</h1><p>one</p><h2>B</h2><p>two</p>")
    (tmp_path / "b.json").write_text('{"k": "v"}')
    (tmp_path / "big.html").write_text("<p>" + "x" * 5000)
    (tmp_path / "c.epub").write_bytes(book("Book", ["<p>page</p>"]))
    (tmp_path / "d.mp3").write_bytes(b"x")
    o = Options(max_file_size=4000)
    got = {r.source.rsplit("/", 1)[1]: r for r in convert(spark, str(tmp_path), o).collect()}
    assert got["a.html"].markdown == "# A\n\none\n\n## B\n\ntwo" and got["a.html"].quality.overall is not None
    assert got["b.json"].markdown.startswith("| Key | Value |") and got["c.epub"].markdown == "page"
    assert got["big.html"].outcome == "parse_error" and got["big.html"].quality.error and "larger" in got["big.html"].notes[0] and got["d.mp3"].outcome == "parse_error"
    for output, column in (("html", "html"), ("json", "json"), ("chunks", "chunks")):
        assert all(r[column] for r in convert(spark, str(tmp_path / "a.html"), Options(output=output)).collect())
    stream = [t for _, t in convert_stream(spark, str(tmp_path / "a.html"))]
    assert "\n\n".join(stream) == got["a.html"].markdown
    docs, nodes = convert_to_nodes(spark, str(tmp_path / "a.html"))
    assert results(docs, nodes.where("type <> 'heading'")).first().markdown == "one\n\ntwo"
    assert scan(spark, str(tmp_path), 4000).where("content is null").count() == 1


def test_metadata_leads(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T</title><p>one</p>")
    assert convert(spark, str(tmp_path), Options(include_metadata=True)).first().markdown == "---\ntitle: 'T'\nsource_format: html\nword_count: 2\n---\n\none"


def test_images_and_captions(spark, tmp_path):
    from folioflow.operators.images import attach_media
    from folioflow.schema import NODES
    from folioflow.sources.external import caption_images

    out = Outline("docx")
    out.image(path="a.png")
    out.image(kind="decorative", path="b.png")
    out.image(path="bad.png")
    nodes = spark.createDataFrame([{"doc_id": "d"} | n for n in out.nodes], NODES)

    def see(path):
        if "bad" in path:
            raise ValueError("no picture")
        return "a cat"

    named, failed = caption_images(nodes, see)
    assert [r.image.caption for r in named.orderBy("node_id").collect()] == ["a cat", None, None] and failed.first().message == "no picture"
    media = spark.createDataFrame([("d", "image10.png"), ("d", "image2.png")], "doc_id string, name string")
    assert [r.image.path for r in attach_media(nodes, media).orderBy("node_id").collect()] == ["image10.png", "image2.png", "bad.png"]
    assert render.markdown(named.where(F.col("node_id") == 0)).first().markdown == "![a cat](a.png)"

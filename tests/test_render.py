"""Renderers, chunks and quality on small outlines."""

import json

import pytest

from folioflow.operators import chunking, quality
from folioflow.plans import render
from folioflow.schema import DOCUMENTS, NODES
from folioflow.sources.nodes import Outline, cell, flat_items, run


def frames(spark, *outlines):
    docs, nodes = [], []
    for i, out in enumerate(outlines):
        row = out.row()
        docs.append({"doc_id": str(i), "source": f"file{i}"} | {k: row[k] for k in ("outcome", "metadata", "warnings", "notes")})
        nodes += [{"doc_id": str(i)} | n for n in row["nodes"]]
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(nodes, NODES)


def sample():
    out = Outline("docx", {"title": "It's", "word_count": 50, "keywords": ["a", "b"]})
    out.open(1, "Introduction")
    out.paragraph([run("Hello "), run("world", bold=True), run(" a|b", code=True), run("x", italic=True, strike=True), run("y", bold=True, italic=True, href="u")])
    out.items(flat_items([(0, False, [run("Item one")]), (1, True, [run("sub 1")]), (1, True, [run("sub 2")]), (0, False, [run("Item two")])]))
    out.open(1, "Data")
    out.table([[cell("Name", header=True), cell("Value", header=True)], [cell("a\nb"), cell("1")], [cell("short")]])
    out.code("x = 1 < 2", "py")
    out.quote = len(out.nodes)
    out.paragraph("quoted")
    out.paragraph("more\nlines")
    out.quote = None
    out.image(kind="decorative", path="d.png", alt="x")
    out.image(kind="chart", path="images/fig1.png", caption="A bar chart")
    out.image(path="o.png", ocr="seen " * 30)
    return out


def test_markdown(spark):
    _, nodes = frames(spark, sample())
    ocr = "seen " * 30
    assert render.markdown(nodes).first().markdown == "\n\n".join([
        "# Introduction", "Hello **world**` a\\|b`~~*x*~~[***y***](u)", "- Item one\n  1. sub 1\n  2. sub 2\n- Item two", "# Data",
        "| Name | Value |\n| --- | --- |\n| a b | 1 |\n| short |  |", "```py\nx = 1 < 2\n```", "> quoted\n> \n> more\n> lines", "![A bar chart](images/fig1.png)", f"![{ocr[:80]}](o.png)\n\n```\n{ocr}\n```",
    ])


def test_stream_joins_to_the_whole(spark):
    _, nodes = frames(spark, sample())
    parts = [r.markdown for r in render.section_markdown(nodes).orderBy("section").collect()]
    assert "\n\n".join(parts) == render.markdown(nodes).first().markdown


def test_html(spark):
    _, nodes = frames(spark, sample())
    got = render.html_document(nodes).first().html
    assert "<h1>Introduction</h1>\n<p>Hello <strong>world</strong><code> a|b</code><s><em>x</em></s><a href=\"u\"><strong><em>y</em></strong></a></p>" in got
    assert "<ul>\n<li>Item one<ol>\n<li>sub 1</li>\n<li>sub 2</li>\n</ol></li>\n<li>Item two</li>\n</ul>" in got
    assert "<table>\n<thead><tr>\n<th>Name</th>\n<th>Value</th>\n</tr></thead>\n<tbody>\n<tr>\n<td>a\nb</td>" in got
    assert "<pre><code>x = 1 &lt; 2</code></pre>" in got and "<blockquote>\n<p>quoted</p>\n<p>more\nlines</p>\n</blockquote>" in got and "d.png" not in got


def test_json(spark):
    docs, nodes = frames(spark, sample())
    got = json.loads(render.json_document(nodes, docs).first().json)
    assert got["title"] == "It's" and got["format"] == "docx"
    kinds = [n["type"] for n in got["nodes"]]
    assert kinds == ["heading", "paragraph", "list", "heading", "table", "code", "blockquote", "image", "image", "image"]
    items = got["nodes"][2]["items"]
    assert items[0] == {"content": "Item one", "children": [{"type": "list", "ordered": True, "items": [{"content": "sub 1"}, {"content": "sub 2"}]}]} and items[1] == {"content": "Item two"}
    assert got["nodes"][4] == {"type": "table", "headers": ["Name", "Value"], "rows": [["a\nb", "1"], ["short"]]}
    assert got["nodes"][6]["nodes"] == [{"type": "paragraph", "content": "quoted"}, {"type": "paragraph", "content": "more\nlines"}]


def test_odd_tables(spark):
    a, b = Outline("x"), Outline("x")
    a.table([[cell("<h>", header=True)], [cell("v|w")]], merged=True)
    b.table([[cell("h")], [cell("v")]], caption="C", truncated=True, total_rows=9)
    _, nodes = frames(spark, a, b)
    got = {r.doc_id: r.markdown for r in render.markdown(nodes).collect()}
    assert got["0"] == "<table><thead><tr><th>&lt;h&gt;</th></tr></thead><tbody><tr><td>v\\|w</td></tr></tbody></table>"
    assert got["1"] == "*C*\n\n<!-- Table truncated: showing first rows of 9 total -->\n| h |\n| --- |\n| v |"


def test_pagination(spark):
    rows = spark.createDataFrame([("d", 0, 1, "a"), ("d", 1, 1, "b"), ("d", 2, None, "c"), ("d", 3, 2, "e")], "doc_id string, section int, page int, markdown string")
    assert [r.markdown for r in render.paginated(rows).orderBy("section").collect()] == ["a", "b", "c", "---\n*Page 2*\n\ne"]


def test_front_matter(spark):
    docs, _ = frames(spark, sample(), Outline("txt"))
    got = [r.f for r in docs.orderBy("doc_id").select(render.front_matter(docs.metadata).alias("f")).collect()]
    assert got[0] == "---\ntitle: \"It's\"\nkeywords: ['a', 'b']\nsource_format: docx\nword_count: 50\n---" and got[1] == "---\nsource_format: txt\n---"


def packed(parts, prefix="", bound=800):
    if (len(prefix) + len("\n\n".join(parts))) // 4 <= bound:
        return [prefix + "\n\n".join(parts)]
    bins, now, n = [], [], len(prefix) // 4
    for p in parts:
        if now and n + len(p) // 4 > bound:
            bins.append(now)
            now, n = [p], len(p) // 4
        else:
            now.append(p)
            n += len(p) // 4
    bins.append(now)
    return [(prefix if i == 0 else "") + "\n\n".join(b) for i, b in enumerate(bins)]


@pytest.mark.parametrize("sizes", [[500, 400, 300, 700], [1800, 1800, 1800], [10], [4000, 1], [3200, 4, 4]])
def test_packing(spark, sizes):
    out = Outline("x")
    out.open(9, "Head")
    for s in sizes:
        out.paragraph("x" * s)
    _, nodes = frames(spark, out)
    got = chunking.chunks(nodes).orderBy("chunk_id").collect()
    want = packed(["x" * s for s in sizes], "#" * 9 + " Head\n\n")
    assert [r.content for r in got] == want and [r.token_count for r in got] == [len(w) // 4 for w in want]
    assert {r.heading_path for r in got} == {"Head"} and len({r.chunk_id for r in got}) == len(want)


def test_chunks_of_sections(spark):
    out = Outline("x")
    out.paragraph("before")
    top = out.open(1, "Top")
    out.paragraph("p")
    out.table([[cell(str(i))] for i in range(200)])
    out.paragraph("after")
    out.open(2, "> Sub", top)
    out.open(2, "Tabled", top)
    out.table([[cell("t")]])
    out.paragraph("tail")
    docs, nodes = frames(spark, out)
    got = chunking.chunks(nodes, docs).orderBy("chunk_id").collect()
    assert [(r.type, r.heading_path) for r in got] == [("section", ""), ("section", "Top"), ("table", "Top"), ("section", "Top"), ("section", "Top > > Sub"), ("table", "Top > Tabled"), ("section", "Top > Tabled")]
    assert [r.content for r in got][:2] == ["before", "# Top\n\np"] and got[3].content == "after" and got[4].content == "## > Sub" and got[6].content == "tail"
    assert [r.chunk_id[-5:] for r in got] == [f"_{i:04d}" for i in range(7)]
    assert [r.chunk_id for r in got] == [r.chunk_id for r in chunking.chunks(nodes, docs).orderBy("chunk_id").collect()]


def test_quality(spark):
    plain = Outline("x", {"word_count": None})
    plain.open(1, "H")
    plain.paragraph("Content")
    scanned = Outline("pdf", outcome="ocr_required")
    listed = Outline("x")
    listed.items(flat_items([(0, False, [run("only a list")])]))
    docs, nodes = frames(spark, sample(), plain, scanned, listed)
    got = {r.doc_id: r for r in quality.quality(nodes, docs, render.markdown(nodes)).collect()}
    assert got["0"].heading_preservation == got["0"].table_preservation == got["0"].list_preservation == 1.0 and 0 <= got["0"].token_reduction_ratio <= 1
    assert got["1"].overall == 1.0 and got["1"].token_reduction_ratio is None and got["1"].passed
    assert got["2"].overall is None and got["2"].error == "OCR is required but not enabled" and not got["2"].passed
    assert got["3"].error == "No content extracted from document" and got["3"].has_any_text


def test_rows_render_as_tables_of_nodes_do(spark):
    from folioflow.plans import convert
    from folioflow.sources.nodes import flat_items
    from folioflow.sources.registry import Format, Registry

    quoted, empty = sample(), Outline("x")
    top = quoted.open(2, "Said | so")
    quoted.quote = 1
    quoted.paragraph("one\ntwo", bold=True)
    quoted.items(flat_items([(0, True, [run("a")]), (1, False, [run("b", code=True)])]))
    quoted.quote = None
    quoted.image(alt="a picture", path="p.png", ocr="words")
    quoted.open(3, "Below", top)
    quoted.table([[cell(str(i))] for i in range(300)], caption="c", truncated=True, total_rows=900)
    made = {b"0": quoted, b"1": empty, b"2": sample()}
    formats = Registry()
    formats.register(Format("x", (".x",), lambda content, options: made[content]))
    sources = spark.createDataFrame([(str(i), f"s{i}", ".x", k) for i, k in enumerate(made)] + [("9", "s9", ".none", b"")], "doc_id string, source string, ext string, content binary")
    plain = lambda rows: sorted((r.asDict(True) for r in rows.collect()), key=lambda r: r["doc_id"])
    for output in ("markdown", "html", "json", "chunks"):
        options = convert.Options(output=output, include_metadata=output == "markdown")
        in_rows = plain(convert.convert_sources(sources, options, formats))
        docs, nodes = convert.to_nodes(sources, options, formats)
        by_nodes = plain(convert.results(docs, nodes, options))
        for r in by_nodes:
            if r["quality"] is None or output != "markdown":
                r.update({output: r[output] or {"chunks": [], "html": ""}.get(output, r[output])})
        assert [r["doc_id"] for r in in_rows] == ["0", "1", "2", "9"]
        assert in_rows == by_nodes, output

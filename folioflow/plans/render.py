"""Renderers: nodes to Markdown, semantic HTML and JSON, as column expressions.

A document as it was parsed is one row with an array of nodes, and renders in that
row (``markdown_of``, ``html_of``, ``json_of``). A table of nodes renders row by row
and is then put together by one grouping on ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import escape_html, has_text, quoted, strip

MAX_LEVEL = 6
#: Gives the fields of a node: ``F.col`` of a node row, ``getField`` of an array's element.
Field = Callable[[str], Column]


def _wrap(text: Column, on: Column, front: str, back: str | None = None) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(front), text, F.lit(back or front))).otherwise(text)


def _emphasis(text: Column, run: Column, both: tuple[str, str], bold: tuple[str, str], italic: tuple[str, str]) -> Column:
    b, i = F.coalesce(run["bold"], F.lit(False)), F.coalesce(run["italic"], F.lit(False))
    out = lambda marks: F.concat(F.lit(marks[0]), text, F.lit(marks[1]))
    return F.when(b & i, out(both)).when(b, out(bold)).when(i, out(italic)).otherwise(text)


_STARS = (("***", "***"), ("**", "**"), ("*", "*"))


def _linked(text: Column, run: Column) -> Column:
    href = run["href"]
    return F.when(F.coalesce(href, F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")"))).otherwise(text)


def run_markdown(run: Column) -> Column:
    text = F.replace(F.coalesce(run["text"], F.lit("")), F.lit("|"), F.lit("\\|"))
    plain = _wrap(_emphasis(text, run, *_STARS), run["strike"], "~~")
    return _linked(F.when(F.coalesce(run["code"], F.lit(False)), F.concat(F.lit("`"), text, F.lit("`"))).otherwise(plain), run)


def run_json(run: Column) -> Column:
    text = _emphasis(F.coalesce(run["text"], F.lit("")), run, *_STARS)
    return _linked(_wrap(_wrap(text, run["strike"], "~~"), run["code"], "`"), run)


def run_html(run: Column) -> Column:
    text = escape_html(F.coalesce(run["text"], F.lit("")))
    rich = _emphasis(text, run, ("<strong><em>", "</em></strong>"), ("<strong>", "</strong>"), ("<em>", "</em>"))
    text = F.when(F.coalesce(run["code"], F.lit(False)), F.concat(F.lit("<code>"), text, F.lit("</code>"))).otherwise(_wrap(rich, run["strike"], "<s>", "</s>"))
    href = F.coalesce(run["href"], F.lit(""))
    return F.when(href != "", F.concat(F.lit('<a href="'), escape_html(href), F.lit('">'), text, F.lit("</a>"))).otherwise(text)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def runs_with(runs: Column, one) -> Column:
    return F.array_join(F.transform(runs, one), "")


def cell_with(cell: Column, one) -> Column:
    return F.array_join(F.transform(cell["parts"], lambda p: runs_with(p, one)), " ")


def table_grid(table: Column, one) -> Column:
    """Text of each cell, a row an array."""
    return F.transform(table["rows"], lambda row: F.transform(row, lambda c: cell_with(c, one)))


def _present(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def gfm_from_grid(grid: Column) -> Column:
    """A pipe table of an array of rows of cell texts; short rows are filled up, line ends become spaces."""
    width = F.array_max(F.transform(grid, F.size))
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: strip(F.replace(c, F.lit("\n"), F.lit(" ")))))
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    drawn = F.transform(clean, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, F.greatest(F.size(grid), F.lit(1)))), "\n")).otherwise("")


def table_markdown(table: Column) -> Column:
    caption = F.when(_present(table["caption"]), F.concat(F.lit("*"), table["caption"], F.lit("*\n\n"))).otherwise("")
    cut = F.when(
        F.coalesce(table["truncated"], F.lit(False)) & (F.coalesce(table["total_rows"], F.lit(0)) > 0),
        F.concat(F.lit("<!-- Table truncated: showing first rows of "), table["total_rows"].cast("string"), F.lit(" total -->\n")),
    ).otherwise("")
    odd = F.coalesce(table["merged"], F.lit(False)) | F.coalesce(table["complex"], F.lit(False))
    pipes = F.concat(caption, cut, gfm_from_grid(table_grid(table, run_markdown)))
    return F.when(F.size(table["rows"]) <= 0, "").when(odd, table_as_html(table)).otherwise(pipes)


def table_as_html(table: Column) -> Column:
    """The HTML that stands in Markdown for tables which pipes can't show."""
    shown = F.transform(table["rows"], lambda row: F.transform(row, lambda c: escape_html(cell_with(c, run_markdown))))
    head = F.forall(table["rows"][0], lambda c: F.coalesce(c["header"], F.lit(False)))
    cells = lambda row, tag: F.array_join(F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), "")
    rows = F.transform(F.when(head, F.slice(shown, 2, F.greatest(F.size(shown), F.lit(1)))).otherwise(shown), lambda row: F.concat(F.lit("<tr>"), cells(row, "td"), F.lit("</tr>")))
    top = F.when(head, F.concat(F.lit("<thead><tr>"), cells(shown[0], "th"), F.lit("</tr></thead>"))).otherwise("")
    return F.concat(F.lit("<table>"), top, F.lit("<tbody>"), F.array_join(rows, ""), F.lit("</tbody></table>"))


def table_html(table: Column) -> Column:
    shown = table_grid(table, run_html)
    cells = lambda row, tag: F.transform(row, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")))
    head = F.concat(F.array(F.lit("<thead><tr>")), cells(shown[0], "th"), F.array(F.lit("</tr></thead>")))
    body = F.flatten(F.transform(F.slice(shown, 2, F.greatest(F.size(shown), F.lit(1))), lambda row: F.concat(F.array(F.lit("<tr>")), cells(row, "td"), F.array(F.lit("</tr>")))))
    body = F.when(F.size(shown) > 1, F.concat(F.array(F.lit("<tbody>")), body, F.array(F.lit("</tbody>")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(table["rows"]) <= 0, "").otherwise(F.array_join(F.concat(F.array(F.lit("<table>")), head, body, F.array(F.lit("</table>"))), "\n"))


def items_markdown(items: Column) -> Column:
    mark = lambda i: F.when(i["ordered"], F.concat(i["ord"].cast("string"), F.lit("."))).otherwise("-")
    return F.array_join(F.transform(items, lambda i: F.concat(F.repeat(F.lit("  "), i["depth"]), mark(i), F.lit(" "), runs_with(i["runs"], run_markdown))), "\n")


def _nested(items: Column, text, opening, joint: str, closing, item_end: str) -> Column:
    """Flat items as nested text: a fold that keeps the kinds of the open lists."""
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<boolean>").alias("open"))

    def step(s: Column, i: Column) -> Column:
        deeper = i["depth"] >= F.size(s["open"])
        ends = F.slice(F.reverse(s["open"]), 1, F.greatest(F.size(s["open"]) - i["depth"] - 1, F.lit(0)))
        up = F.aggregate(ends, F.lit(""), lambda a, kind: F.concat(a, F.lit(item_end), closing(kind)))
        kept = F.slice(s["open"], 1, i["depth"] + 1)
        out = F.when(deeper, F.concat(s["out"], opening(i["ordered"]), text(i))).otherwise(F.concat(s["out"], up, F.lit(item_end + joint), text(i)))
        return F.struct(out.alias("out"), F.when(deeper, F.concat(s["open"], F.array(i["ordered"]))).otherwise(kept).alias("open"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.aggregate(F.reverse(s["open"]), F.lit(""), lambda a, kind: F.concat(a, F.lit(item_end), closing(kind))))

    return F.aggregate(items, start, step, finish)


def items_html(items: Column) -> Column:
    tag = lambda kind: F.when(kind, "ol").otherwise("ul")
    return _nested(
        items,
        lambda i: F.concat(F.lit("<li>"), runs_with(i["runs"], run_html)),
        lambda kind: F.concat(F.lit("<"), tag(kind), F.lit(">\n")),
        "\n",
        lambda kind: F.concat(F.lit("\n</"), tag(kind), F.lit(">")),
        "</li>",
    )


def _json_string(text: Column) -> Column:
    """One JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def items_json(items: Column) -> Column:
    """The list node of flat items as JSON text."""
    head = lambda kind: F.concat(F.lit('{"type":"list","ordered":'), kind.cast("string"), F.lit(',"items":['))
    first = F.struct(F.lit("").alias("out"), F.array().cast("array<boolean>").alias("open"))

    def step(s: Column, i: Column) -> Column:
        n = F.size(s["open"])
        deeper = i["depth"] >= n
        closing = F.greatest(n - i["depth"] - 1, F.lit(0))
        text = F.concat(F.lit('{"content":'), _json_string(runs_with(i["runs"], run_json)))
        opening = F.concat(F.when(n > 0, ',"children":[').otherwise(""), head(i["ordered"]), text)
        nxt = F.concat(F.repeat(F.lit("}]}]"), closing), F.lit("},"), text)
        return F.struct(F.concat(s["out"], F.when(deeper, opening).otherwise(nxt)).alias("out"), F.when(deeper, F.concat(s["open"], F.array(i["ordered"]))).otherwise(F.slice(s["open"], 1, i["depth"] + 1)).alias("open"))

    return F.aggregate(items, first, step, lambda s: F.concat(s["out"], F.repeat(F.lit("}]}]"), F.greatest(F.size(s["open"]) - 1, F.lit(0))), F.lit("}]}")))


def image_markdown(image: Column) -> Column:
    alt = F.coalesce(F.nullif(image["caption"], F.lit("")), F.substring(F.nullif(image["ocr"], F.lit("")), 1, 80), F.nullif(image["alt"], F.lit("")), F.lit(""))
    src = F.coalesce(image["path"], F.lit(""))
    ocr = F.when(_present(image["ocr"]), F.concat(F.lit("\n\n```\n"), image["ocr"], F.lit("\n```"))).otherwise("")
    hidden = (F.coalesce(image["kind"], F.lit("")) == "decorative") | ((alt == "") & (src == ""))
    return F.when(hidden, "").otherwise(F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"), ocr))


def image_html(image: Column) -> Column:
    alt = escape_html(F.coalesce(F.nullif(image["caption"], F.lit("")), image["alt"], F.lit("")))
    src = escape_html(F.coalesce(image["path"], F.lit("")))
    return (
        F.when(F.coalesce(image["kind"], F.lit("")) == "decorative", "")
        .when(_present(image["ocr"]), F.concat(F.lit("<pre><code>"), escape_html(strip(image["ocr"])), F.lit("</code></pre>")))
        .when(src != "", F.concat(F.lit('<img src="'), src, F.lit('" alt="'), alt, F.lit('">')))
        .when(alt != "", F.concat(F.lit("<p>"), alt, F.lit("</p>")))
        .otherwise("")
    )


def node_markdown(of: Field = F.col) -> Column:
    """The Markdown of a node, without the marks of a quote around it; ``of`` gives its fields."""
    kind = of("type")
    heading = F.concat(F.repeat(F.lit("#"), F.least(of("level"), F.lit(MAX_LEVEL))), F.lit(" "), runs_with(of("runs"), run_markdown))
    code = F.concat(F.lit("```"), F.coalesce(of("language"), F.lit("")), F.lit("\n"), of("code"), F.lit("\n```"))
    return (
        F.when(kind == "heading", heading)
        .when(kind == "paragraph", runs_with(of("runs"), run_markdown))
        .when(kind == "table", table_markdown(of("table")))
        .when(kind == "list", items_markdown(of("items")))
        .when(kind == "code", code)
        .when(kind == "image", image_markdown(of("image")))
        .otherwise("")
    )


def node_html(of: Field = F.col) -> Column:
    kind = of("type")
    level = F.greatest(F.lit(1), F.least(F.coalesce(of("level"), F.lit(1)), F.lit(MAX_LEVEL))).cast("string")
    inner = runs_with(of("runs"), run_html)
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), escape_html(runs_text(of("runs"))), F.lit("</h"), level, F.lit(">")))
        .when(kind == "paragraph", F.when(has_text(inner), F.concat(F.lit("<p>"), inner, F.lit("</p>"))).otherwise(""))
        .when(kind == "table", table_html(of("table")))
        .when(kind == "list", items_html(of("items")))
        .when(kind == "code", F.concat(F.lit("<pre><code>"), escape_html(F.coalesce(of("code"), F.lit(""))), F.lit("</code></pre>")))
        .when(kind == "image", image_html(of("image")))
        .otherwise("")
    )


def node_json(of: Field = F.col) -> Column:
    """The JSON text of a node; absent fields are left out."""
    kind, t, g = of("type"), of("table"), table_grid(of("table"), run_json)
    content = runs_with(of("runs"), run_json)
    table = F.to_json(
        F.struct(
            F.lit("table").alias("type"),
            F.nullif(t["caption"], F.lit("")).alias("caption"),
            F.when(t["truncated"], F.lit(True)).alias("truncated"),
            t["total_rows"].alias("total_rows"),
            F.when(F.size(g) > 0, g[0]).otherwise(F.array().cast("array<string>")).alias("headers"),
            F.when(F.size(g) > 1, F.slice(g, 2, F.size(g))).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
        )
    )
    image = F.to_json(F.struct(F.lit("image").alias("type"), F.nullif(of("image")["kind"], F.lit("")).alias("image_type"), *[F.nullif(of("image")[a], F.lit("")).alias(b) for a, b in (("alt", "alt_text"), ("caption", "caption"), ("ocr", "ocr_text"), ("path", "path"))]))
    return (
        F.when(kind == "heading", F.to_json(F.struct(F.lit("heading").alias("type"), of("level"), content.alias("content"))))
        .when(kind == "paragraph", F.to_json(F.struct(F.lit("paragraph").alias("type"), content.alias("content"))))
        .when(kind == "table", table)
        .when(kind == "list", F.when(F.size(of("items")) > 0, items_json(of("items"))).otherwise('{"type":"list","ordered":false,"items":[]}'))
        .when(kind == "code", F.to_json(F.struct(F.lit("code").alias("type"), F.coalesce(of("code"), F.lit("")).alias("content"), F.nullif(of("language"), F.lit("")).alias("language"))))
        .when(kind == "image", image)
    )


def _ordered(nodes: DataFrame, text: Column, keep: Column) -> DataFrame:
    """(doc_id, parts): the texts of a document in order, with the quote that each stands in."""
    own = nodes.select("doc_id", "node_id", "quote", text.alias("text")).where(keep)
    return own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "quote", "text"))).alias("parts"))


def _parts_of(nodes: Column, text: Callable[[Field], Column], keep: Callable[[Column], Column]) -> Column:
    """As ``_ordered``, of an array of nodes in order."""
    shown = F.transform(nodes, lambda n: F.struct(n["node_id"].alias("node_id"), n["quote"].alias("quote"), text(n.getField).alias("text")))
    return F.filter(shown, lambda p: keep(p["text"]))


def _joined(parts: Column, gap: str, quote_line: str | None = None, open_: str = "", close: str = "") -> Column:
    """Parts with ``gap`` between; runs of one quote are marked by line or by what opens and closes them."""
    def piece(own: Column, p: Column, i: Column) -> Column:
        before = F.get(own, i - 1)["quote"]
        same = F.coalesce(before == p["quote"], F.lit(False))
        if quote_line is not None:
            text = F.when(p["quote"].isNull(), p["text"]).otherwise(F.concat(F.lit(quote_line), F.replace(p["text"], F.lit("\n"), F.lit("\n" + quote_line))))
            between = F.when(i == 0, "").when(same, F.lit("\n" + quote_line + "\n")).otherwise(gap)
        else:
            text = F.concat(F.when(p["quote"].isNotNull() & ~same, open_).otherwise(""), p["text"])
            between = F.concat(F.when(before.isNotNull() & ~same, close).otherwise(""), F.when(i == 0, "").otherwise(gap))
        return F.concat(between, text)

    def whole(own: Column) -> Column:
        ends = F.when(F.get(own, F.size(own) - 1)["quote"].isNotNull(), close).otherwise("")
        plain = F.array_join(F.transform(own, lambda p: p["text"]), gap)  # without quotes no part is copied but into the whole
        marked = F.concat(F.array_join(F.transform(own, lambda p, i: piece(own, p, i)), ""), ends)
        return F.when(F.exists(own, lambda p: p["quote"].isNotNull()), marked).otherwise(plain)

    # bound as a variable, the parts are made once; joined at once, a long document costs no more than its length
    return F.transform(F.array(parts), whole)[0]


def markdown(nodes: DataFrame) -> DataFrame:
    """(doc_id, markdown): whole documents; blank nodes are left out."""
    parts = _ordered(nodes, node_markdown(), has_text(F.col("text")))
    return parts.select("doc_id", _joined(F.col("parts"), "\n\n", "> ").alias("markdown"))


def markdown_of(nodes: Column) -> Column:
    """The Markdown of a document's array of nodes."""
    return _joined(_parts_of(nodes, node_markdown, has_text), "\n\n", "> ")


def section_markdown(nodes: DataFrame) -> DataFrame:
    """(doc_id, section, markdown): what a stream of a document gives, a row per section that shows something."""
    own = nodes.select("doc_id", "section", "node_id", "quote", node_markdown().alias("text")).where(has_text(F.col("text")))
    parts = own.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("node_id", "quote", "text"))).alias("parts"))
    return parts.select("doc_id", "section", _joined(F.col("parts"), "\n\n", "> ").alias("markdown"))


def paginated(sections: DataFrame, page: str = "page") -> DataFrame:
    """Section Markdown with a mark wherever the page changes after the first; needs (doc_id, section, page, markdown)."""
    before = F.expr(f"last({page}, true) over (partition by doc_id order by section rows between unbounded preceding and 1 preceding)")
    turned = F.col("before").isNotNull() & F.col(page).isNotNull() & (F.col("before") != F.col(page))
    mark = F.concat(F.lit("---\n*Page "), F.col(page).cast("string"), F.lit("*\n\n"))
    return sections.withColumn("before", before).withColumn("markdown", F.concat(F.when(turned, mark).otherwise(""), "markdown")).drop("before")


_QUOTE_HTML = ("<blockquote>\n", "\n</blockquote>")
_QUOTE_JSON = ('{"type":"blockquote","nodes":[', "]}")


def html_document(nodes: DataFrame) -> DataFrame:
    """(doc_id, html)."""
    parts = _ordered(nodes, node_html(), F.col("text") != "")
    return parts.select("doc_id", _joined(F.col("parts"), "\n", None, *_QUOTE_HTML).alias("html"))


def html_of(nodes: Column) -> Column:
    return _joined(_parts_of(nodes, node_html, lambda text: text != ""), "\n", None, *_QUOTE_HTML)


def _with_metadata(listed: Column, metadata: Column | None) -> Column:
    """The nodes' JSON as an object with, where there is metadata, title and format."""
    nodes = F.concat(F.lit('{"nodes":['), listed, F.lit("]"))
    if metadata is None:
        return F.concat(nodes, F.lit("}"))
    meta = F.to_json(F.struct(F.nullif(metadata["title"], F.lit("")).alias("title"), F.nullif(metadata["source_format"], F.lit("")).alias("format")))
    return F.concat(nodes, F.when(meta == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(meta, 2, 1 << 30))))


def json_document(nodes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): ``{"nodes": [...]}`` and, with ``docs``, title and format."""
    parts = _ordered(nodes, node_json(), F.col("text").isNotNull())
    out = parts.select("doc_id", _joined(F.col("parts"), ",", None, *_QUOTE_JSON).alias("listed"))
    if docs is None:
        return out.select("doc_id", _with_metadata(F.col("listed"), None).alias("json"))
    joined = docs.select("doc_id", "metadata").join(out, "doc_id", "left")
    return joined.select("doc_id", _with_metadata(F.coalesce("listed", F.lit("")), F.col("metadata")).alias("json"))


def json_of(nodes: Column, metadata: Column | None = None) -> Column:
    return _with_metadata(_joined(_parts_of(nodes, node_json, lambda text: text.isNotNull()), ",", None, *_QUOTE_JSON), metadata)


def front_matter(meta: Column) -> Column:
    """The lines of known metadata between rules, or nothing if none is known."""
    text = lambda name, field, show: F.when(_present(meta[field]), F.concat(F.lit(name + ": "), show(meta[field])))
    same = lambda c: c
    words = F.when(F.size(meta["keywords"]) > 0, F.concat(F.lit("keywords: ["), F.array_join(F.transform(meta["keywords"], quoted), ", "), F.lit("]")))
    number = lambda n: F.when(meta[n].isNotNull(), F.concat(F.lit(n + ": "), meta[n].cast("string")))
    lines = [*(text(n, n, quoted) for n in ("title", "author", "subject", "description")), words, text("created", "created_at", same), text("modified", "modified_at", same), text("source_format", "source_format", same), *(number(n) for n in ("page_count", "slide_count", "sheet_count", "word_count"))]
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", "").otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---")))

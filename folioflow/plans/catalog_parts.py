"""Queries on formats and operators that the driver's tables don't hold as they are; inputs are made from those tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import images, paragraphs, quality, service, tables
from folioflow.plans import render
from folioflow.plans.catalog_formats import _cells, _zipped, sources, spread
from folioflow.plans.catalog_text import table
from folioflow.sources.registry import documents_of, nodes_of, parse_sources

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _markdown(parsed):
    return parsed.select("doc_id", render.markdown_of(F.col("nodes")).alias("markdown"))


def _parts(spark, d):
    return table(spark, d, "part").withColumn("doc_id", F.col("p_partkey").cast("string"))


_OBJECTS = "%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[4 0 R 6 0 R]/MediaBox[0 0 600 800]/Resources<</Font<</F1 <</Subtype/Type1/BaseFont/Helvetica>>>>>>>> endobj\n"
_TRAILER = "trailer <</Root 1 0 R/Info 3 0 R>>"


def _pdf_page(number: int, body):
    """A page object and its stream, of a content column."""
    head = F.lit(f"{number} 0 obj <</Type/Page/Parent 2 0 R/Contents {number + 1} 0 R>> endobj\n{number + 1} 0 obj <</Length ")
    return F.concat(head, F.length(body).cast("string"), F.lit(">> stream\n"), body, F.lit("\nendstream endobj\n"))


@query("pdf_markdown", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand AS title, '2024-01-15T10:30:00+05:30' AS created_at, CAST(2 AS INTEGER) AS page_count, CAST(13 + 2 * len(string_split(p_name, ' ')) AS INTEGER) AS words,
       '## Page 1' || chr(10) || chr(10) || '# ' || p_type || chr(10) || chr(10) || 'The part is named ' || p_name || chr(10) || chr(10) || 'and is of size (' || p_size || ')' || chr(10) || chr(10) ||
       '## Page 2' || chr(10) || chr(10) || 'A last page has ' || p_name AS markdown FROM part""")
def pdf_markdown(spark, d):
    say = lambda size, y, text: F.concat(F.lit(f"BT /F1 {size} Tf 72 {y} Td ("), text, F.lit(") Tj ET\n"))
    p = spread(_parts(spark, d), "p_partkey")
    first = F.concat(say(24, 700, F.col("p_type")), say(12, 660, F.concat(F.lit("The part is named "), "p_name")), say(12, 640, F.concat(F.lit("and is of size \\("), F.col("p_size").cast("string"), F.lit("\\)"))), say(12, 785, F.lit("Running head")))
    second = F.concat(say(12, 660, F.concat(F.lit("A last page has "), "p_name")), say(12, 640, F.lit("- 2 -")))
    info = F.concat(F.lit("3 0 obj <</Title("), "p_brand", F.lit(")/CreationDate(D:20240115103000+05'30')>> endobj\n"))
    parsed = parse_sources(sources(p, ".pdf", F.concat(F.lit(_OBJECTS), info, _pdf_page(4, first), _pdf_page(6, second), F.lit(_TRAILER))))
    return parsed.select("doc_id", "metadata.title", "metadata.created_at", "metadata.page_count", F.col("metadata.word_count").alias("words"), render.markdown_of(F.col("nodes")).alias("markdown"))


@query("html_tables", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS tables, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | **' || p_size || '** |' || chr(10) || '| ' || p_brand || ' |  |' AS markdown FROM part""")
def html_tables(spark, d):
    cell = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    size = F.concat(F.lit("<b>"), F.col("p_size").cast("string"), F.lit("</b>"))
    text = F.concat(F.lit("<html><body><table><thead><tr><th>name</th><th>size</th></tr></thead><tbody><tr>"), cell("td", F.col("p_name")), cell("td", size), F.lit("</tr><tr>"), cell("td", F.col("p_brand")), F.lit("</tr></tbody></table></body></html>"))
    parsed = parse_sources(sources(_parts(spark, d), ".html", text))
    counts = quality.counts_of(F.col("nodes"), parsed.schema["nodes"].dataType.elementType["runs"].dataType)
    return parsed.select("doc_id", counts["tables"].alias("tables"), render.markdown_of(F.col("nodes")).alias("markdown"))


@query("html_nesting", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '- ' || p_name || p_brand || 'second' || chr(10) || '  1. ' || p_brand || chr(10) || '  2. second' || chr(10) || '- last' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '```' || chr(10) || 'x = ' || p_size || chr(10) || '```' AS markdown FROM part""")
def html_nesting(spark, d):
    text = F.concat(F.lit("<ul><li>"), "p_name", F.lit("<ol><li>"), "p_brand", F.lit("</li><li>second</li></ol></li><li>last</li></ul><blockquote><p>"), "p_type", F.lit("</p></blockquote><pre><code>x = "), F.col("p_size").cast("string"), F.lit("</code></pre>"))
    return _markdown(parse_sources(sources(_parts(spark, d), ".html", text)))


@query("json_schema_tables", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest([0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]) AS "row", unnest([0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]) AS col,
       unnest(['Name', 'Type', 'Required', 'Description', 'key', 'integer', 'yes', p_name, 'tags', 'array<string>', 'no', '']) AS value FROM part""")
def json_schema_tables(spark, d):
    text = F.concat(F.lit('{"$schema":"x","title":"t","properties":{"key":{"type":"integer","description":"'), "p_name", F.lit('"},"tags":{"type":"array","items":{"type":"string"}}},"required":["key"]}'))
    return _cells(nodes_of(parse_sources(sources(_parts(spark, d), ".json", text)))).drop("section")


_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@query("docx_markdown", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '# ' || p_name || chr(10) || chr(10) || 'is **' || p_brand || '**' || chr(10) || chr(10) || '| size |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |' AS markdown FROM part""")
def docx_markdown(spark, d):
    def make(name, brand, size):
        run = lambda t, bold="": f'<w:r>{bold}<w:t xml:space="preserve">{t}</w:t></w:r>'
        row = lambda t: f"<w:tr><w:tc><w:p>{run(t)}</w:p></w:tc></w:tr>"
        body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(name)}</w:p><w:p>{run("is ")}{run(brand, "<w:rPr><w:b/></w:rPr>")}</w:p><w:tbl>{row("size")}{row(size)}</w:tbl>'
        styles = f'<w:styles {_WORD}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'
        return _zipped({"word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})

    p = _parts(spark, d).select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(".docx").alias("ext"), F.udf(make, "binary")("p_name", "p_brand", "p_size").alias("content"))
    return _markdown(parse_sources(p))


@query("page_marks", """
WITH s AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS section, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey // 3 % 2 AS INTEGER) END AS page, o_orderpriority AS markdown FROM orders),
b AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT doc_id, section, CASE WHEN before <> page THEN '---' || chr(10) || '*Page ' || page || '*' || chr(10) || chr(10) ELSE '' END || markdown AS markdown FROM b""")
def page_marks(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as doc_id", "cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as section", "case when o_orderkey % 5 = 0 then null else cast(o_orderkey div 3 % 2 as int) end as page", "o_orderpriority as markdown")
    return render.paginated(o).drop("page")


@query("layout_blocks", """
WITH i AS (SELECT user_id AS doc_id, event_id AS pos, CASE event_id % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'section_header' WHEN 2 THEN 'text' WHEN 3 THEN 'list_item' WHEN 4 THEN 'list_item' WHEN 5 THEN 'formula' ELSE 'page_footer' END AS label FROM events),
k AS (SELECT *, CASE label WHEN 'title' THEN 'heading' WHEN 'section_header' THEN 'heading' WHEN 'text' THEN 'paragraph' WHEN 'list_item' THEN 'list' ELSE 'code' END AS kind FROM i WHERE label <> 'page_footer'),
f AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = 'list' THEN 0 ELSE 1 END AS fresh FROM k)
SELECT doc_id, pos, kind, CASE label WHEN 'title' THEN 1 WHEN 'section_header' THEN 2 END AS level, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM f""")
def layout_blocks(spark, d):
    label = "case event_id % 7 when 0 then 'title' when 1 then 'section_header' when 2 then 'text' when 3 then 'list_item' when 4 then 'list_item' when 5 then 'formula' else 'page_footer' end as label"
    items = table(spark, d, "events").selectExpr("user_id as doc_id", "event_id as pos", label)
    return paragraphs.labelled_blocks(items).select("doc_id", "pos", "kind", "level", F.col("block").cast("long").alias("block"))


_PLACED = "p_partkey AS id, CAST(p_partkey % 40 AS VARCHAR) AS doc_id, CAST(p_size % 3 AS INTEGER) AS page_number, p_name AS text, CAST(p_partkey * 7 % 600 AS DOUBLE) AS x0, CAST(p_partkey * 11 % 800 AS DOUBLE) AS top, CAST(800.0 AS DOUBLE) AS page_h"
_BOXES = "CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(n_nationkey % 3 AS INTEGER) AS page_number, CAST(0 AS INTEGER) AS table_no, CAST(100 AS DOUBLE) AS x0, CAST(300 AS DOUBLE) AS x1, CAST(200 AS DOUBLE) AS top, CAST(500 AS DOUBLE) AS bottom"


@query("body_words", f"""
WITH w AS (SELECT {_PLACED} FROM part), b AS (SELECT {_BOXES} FROM nation)
SELECT w.id FROM w WHERE top BETWEEN 40 AND 720 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND b.page_number = w.page_number AND w.x0 BETWEEN b.x0 AND b.x1 AND w.top BETWEEN b.top AND b.bottom)""")
def body_words(spark, d):
    return paragraphs.body_words(table(spark, d, "part").selectExpr(*_exprs(_PLACED)), table(spark, d, "nation").selectExpr(*_exprs(_BOXES))).select("id")


def _exprs(columns: str) -> list[str]:
    return [c.replace("VARCHAR", "STRING").replace("INTEGER", "INT") for c in columns.split(", ")]


@query("words_in_cells", f"""
WITH w AS (SELECT {_PLACED} FROM part), b AS (SELECT {_BOXES} FROM nation),
c AS (SELECT doc_id, page_number, table_no, CAST(r AS INTEGER) AS "row", CAST(0 AS INTEGER) AS col, x0, x1, top + 100 * r AS top, top + 100 * (r + 1) AS bottom FROM b, (SELECT unnest([0, 1, 2]) AS r))
SELECT c.doc_id, c.page_number, c.table_no, c."row", c.col, coalesce(string_agg(w.text, ' ' ORDER BY w.top, w.x0, w.text), '') AS value
FROM c LEFT JOIN w ON w.doc_id = c.doc_id AND w.page_number = c.page_number AND w.x0 >= c.x0 AND w.x0 < c.x1 AND w.top >= c.top AND w.top < c.bottom GROUP BY 1, 2, 3, 4, 5""")
def words_in_cells(spark, d):
    boxes = table(spark, d, "nation").selectExpr(*_exprs(_BOXES)).withColumn("row", F.explode(F.array(*map(F.lit, range(3)))))
    cells = boxes.withColumn("col", F.lit(0)).withColumn("bottom", F.col("top") + 100 * (F.col("row") + 1)).withColumn("top", F.col("top") + 100 * F.col("row"))
    return paragraphs.words_in_cells(table(spark, d, "part").selectExpr(*_exprs(_PLACED)), cells)


@query("quality_warnings", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Heading preservation low (50%): 2 in source, 1 in output; Table preservation low (0%): 1 in source' ELSE '' END AS warnings,
       CASE WHEN p_partkey % 3 = 2 THEN 'No content extracted from document' END AS error, p_partkey % 3 <> 2 AS valid_markdown FROM part""")
def quality_warnings(spark, d):
    p = _parts(spark, d)
    full = F.concat(F.lit("<h1>A</h1><h2>"), "p_name", F.lit("</h2><p>some text</p><table><tr><th>a</th></tr><tr><td>b</td></tr></table>"))
    parsed = parse_sources(sources(p, ".html", F.when(F.col("p_partkey") % 3 == 2, "").otherwise(full)))
    lost = F.when(F.col("doc_id").cast("int") % 3 == 1, F.lit("# A")).otherwise(render.markdown_of(F.col("nodes")))
    return quality.quality_of(parsed.withColumn("markdown", lost)).select("doc_id", F.array_join("warnings", "; ").alias("warnings"), "error", "valid_markdown")


@query("request_checks", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown output format' WHEN p_partkey % 5 = 0 THEN 'unknown image mode' WHEN p_size % 4 = 0 THEN 'unsupported file type' WHEN p_size % 4 = 1 THEN 'unknown priority' WHEN p_size % 4 = 2 THEN 'schema must be a non-empty object' END AS problem FROM part""")
def request_checks(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey", "if(p_partkey % 7 = 0, 'rtf', 'markdown') as output", "if(p_partkey % 5 = 0, 'draw', 'extract') as images", "if(p_size % 4 = 0, '.exe', '.DOCX') as ext",
        "if(p_size % 4 = 1, 'soon', 'Batch') as priority", "case p_size % 4 when 2 then '[]' when 3 then '{\"a\": 1}' end as schema",
    )
    return p.select("p_partkey", service.request_problem(F.col("output"), F.col("images"), F.col("ext"), F.col("priority"), F.col("schema"), (".docx", ".pdf")).alias("problem"))


@query("answers", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '{"quality":{"passed":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || '},"stats":{"words":' || p_size || ',"format":"CSV"},"warnings":[],"markdown":' || CAST(to_json(p_name) AS VARCHAR) || '}' AS body FROM part""")
def answers(spark, d):
    p = _parts(spark, d).selectExpr(
        "doc_id", "named_struct('passed', p_size % 2 = 0) as quality", "array() as warnings", "p_name as markdown",
        "named_struct('word_count', p_size, 'page_count', cast(null as int), 'slide_count', cast(null as int), 'sheet_count', cast(null as int), 'source_format', 'csv') as metadata",
    )
    return service.envelope(p)


@query("media_by_place", """
WITH n AS (SELECT p_partkey % 50 AS doc_id, CAST(p_partkey AS INTEGER) AS node_id, CASE WHEN p_size % 2 = 0 THEN 'image' ELSE 'paragraph' END AS type FROM part),
i AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS place FROM n WHERE type = 'image'),
m AS (SELECT s_suppkey % 50 AS doc_id, s_name AS name, row_number() OVER (PARTITION BY s_suppkey % 50 ORDER BY s_name) AS place FROM supplier)
SELECT n.doc_id, n.node_id, m.name AS path FROM n LEFT JOIN i USING (doc_id, node_id) LEFT JOIN m ON m.doc_id = i.doc_id AND m.place = i.place""")
def media_by_place(spark, d):
    image = "named_struct('kind', 'unknown', 'path', cast(null as string), 'alt', 'a', 'caption', cast(null as string), 'ocr', cast(null as string)) as image"
    nodes = table(spark, d, "part").selectExpr("p_partkey % 50 as doc_id", "cast(p_partkey as int) as node_id", "if(p_size % 2 = 0, 'image', 'paragraph') as type", image)
    media = table(spark, d, "supplier").selectExpr("s_suppkey % 50 as doc_id", "s_name as name")
    return images.attach_media(nodes, media).select("doc_id", "node_id", F.col("image.path").alias("path"))


@query("ddl_indexes", """
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, unnest(['Table: t > Index: idx_' || n_nationkey, 'Index: other', 'Table: late', 'Index: early']) AS path FROM nation""")
def ddl_indexes(spark, d):
    n = table(spark, d, "nation").withColumn("doc_id", F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("CREATE TABLE t (id INTEGER);\nCREATE INDEX idx_"), "doc_id", F.lit(" ON T (id);\nCREATE INDEX other ON elsewhere (x);\nCREATE INDEX early ON late (x);\nCREATE TABLE late (x INTEGER);"))
    own = nodes_of(parse_sources(sources(n, ".sql", text))).where("type = 'heading' and path[size(path) - 1] <> 'Table: t'")
    return own.select("doc_id", F.array_join("path", " > ").alias("path"))


@query("small_strings", """
SELECT p_partkey, p_brand || '|' || p_type AS words, '{"k": ' || p_size || '}' AS unfenced, '<a>' || p_name || ' &amp; ' || p_type || ' &lt;</a>' AS xml, 'abcdefghijklmnopqrstuvwxyz' || p_partkey AS file_id, CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE 'image/png' END AS media, p_partkey % 2 = 0 AS transient FROM part""")
def small_strings(spark, d):
    p = table(spark, d, "part")
    own = F.concat(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("p_partkey").cast("string"))
    address = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://docs.example.com/document/d/"), own, F.lit("/edit"))).otherwise(F.concat(F.lit("https://x.example.com/open?a=b&id="), own))
    return p.select(
        "p_partkey",
        F.array_join(T.keywords(F.concat("p_brand", F.lit("; , "), "p_type", F.lit(","))), "|").alias("words"),
        T.strip_fence(F.concat(F.lit(' ```json\n{"k": '), F.col("p_size").cast("string"), F.lit("}\n``` "))).alias("unfenced"),
        T.xml_sanitised(F.concat(F.lit('<?xml version="1.0"?><a xmlns:q="u">'), "p_name", F.lit(" & "), "p_type", F.lit(" &lt;</a>"))).alias("xml"),
        T.drive_file_id(address).alias("file_id"),
        T.media_type(F.concat(F.lit("a/b."), F.expr("case p_partkey % 3 when 0 then 'JPG' when 1 then 'webp' else 'png' end"))).alias("media"),
        service.error_is_transient(F.when(F.col("p_partkey") % 2 == 0, "TimeoutError").otherwise("ValueError")).alias("transient"),
    )


@query("merged_answers", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a,b;' || p_brand || ',' || p_size END AS rows FROM part""")
def merged_answers(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("| a | b |\n| --- | --- |\n| "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))).otherwise(" separate ").alias("said"))
    merged = tables.merge_tables(p, F.col("said"))
    return merged.select("p_partkey", F.when(F.col("merged").isNotNull(), F.array_join(F.transform("merged", lambda r: F.array_join(r, ",")), ";")).alias("rows"))


@query("parse_outcomes", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'success' ELSE 'parse_error' END AS outcome, CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 0 END AS nodes FROM part""")
def parse_outcomes(spark, d):
    p = _parts(spark, d)
    ext = F.expr("case p_partkey % 4 when 0 then '.csv' when 1 then '.docx' when 2 then '.unknown' else '.pdf' end")
    own = p.select("doc_id", F.lit(None).cast("string").alias("source"), ext.alias("ext"), F.encode(F.concat(F.lit("a,b\r\n"), "p_name"), "utf-8").alias("content"))
    parsed = parse_sources(own)
    return documents_of(parsed.withColumn("n", F.size("nodes"))).select("doc_id", "outcome", F.col("n").alias("nodes"))

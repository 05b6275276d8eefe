"""Queries on texts and pages, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunking, paragraphs, quality
from folioflow.plans import render
from folioflow.sources.registry import nodes_of, parse_sources


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = rf"regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_DIGITS = lambda x: f"({x} <> '' AND translate({x}, '0123456789', '') = '')"
#: Page numbers are told by taking bars and dashes off and looking at what is left, word by word.
_PARAGRAPHS = rf"""
lines AS (SELECT doc_id, source, i, {_STRIP} AS x
          FROM (SELECT doc_id, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS x
                FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
opened AS (SELECT *, CASE WHEN x[1] IN ('|', '-') THEN trim(x[2:]) ELSE x END AS o FROM lines),
closed AS (SELECT *, string_split(CASE WHEN o[-1] IN ('|', '-') THEN trim(o[:-2]) ELSE o END, 'of') AS parts FROM opened),
p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, x AS paragraph FROM closed
      WHERE x <> '' AND NOT (o[1:5] IN ('Page ', 'page ') AND {_DIGITS("trim(o[5:])")})
        AND NOT ({_DIGITS("trim(parts[1])")} AND (len(parts) = 1 OR len(parts) = 2 AND parts[2][1] = ' ' AND {_DIGITS("trim(parts[2])")})))"""
_PACKED = f"""
WITH RECURSIVE {_PARAGRAPHS},
w AS (SELECT doc_id, (sum(length(paragraph)) + 2 * (count(*) - 1)) // 4 <= 800 AS whole FROM p GROUP BY doc_id),
f(doc_id, n, bin, cur) AS (
  SELECT doc_id, n, 0, length(paragraph) // 4 FROM p WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, CASE WHEN NOT w.whole AND f.cur + length(paragraph) // 4 > 800 THEN f.bin + 1 ELSE f.bin END,
         CASE WHEN NOT w.whole AND f.cur + length(paragraph) // 4 > 800 THEN length(paragraph) // 4 ELSE f.cur + length(paragraph) // 4 END
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1 JOIN w ON w.doc_id = p.doc_id),
c AS (SELECT p.doc_id, p.source || '/' || p.doc_id AS source_document, f.bin, string_agg(paragraph, chr(10) || chr(10) ORDER BY p.n) AS content
      FROM p JOIN f ON p.doc_id = f.doc_id AND p.n = f.n GROUP BY 1, 2, 3)"""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("rag_chunks", f"""{_PACKED}
SELECT doc_id, substr(md5(source_document), 1, 8) || '_' || lpad(CAST(bin AS VARCHAR), 4, '0') AS chunk_id, 'section' AS type, content, source_document,
       CAST(length(content) // 4 AS INTEGER) AS token_count FROM c""")
def rag_chunks(spark, d):
    return chunking.chunk_texts(table(spark, d, "documents"))


@query("chunk_stats", f"""{_PACKED}
SELECT split_part(source_document, '/', 1) AS source, count(*) AS n_chunks, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, CAST(max(length(content) // 4) AS INTEGER) AS largest FROM c GROUP BY 1""")
def chunk_stats(spark, d):
    own = chunking.chunk_texts(table(spark, d, "documents")).withColumn("source", F.substring_index("source_document", "/", 1))
    return own.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


@query("paragraph_split", f"WITH {_PARAGRAPHS} SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, paragraph FROM p")
def paragraph_split(spark, d):
    return paragraphs.paragraphs(table(spark, d, "documents"))


@query("ocr_paragraphs", r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, x AS paragraph
FROM (SELECT doc_id, generate_subscripts(g, 1) AS i, regexp_replace(unnest(g), '^[\s]+|[\s]+$', '', 'g') AS x
      FROM (SELECT doc_id, list_transform(string_split(regexp_replace(replace(coalesce(text, ''), '.' || chr(10), '.' || chr(10) || chr(10)), '\n\n+', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda y: replace(y, chr(10), ' ')) AS g FROM documents))
WHERE x <> '' AND NOT regexp_matches(x, '^\d+$')""")
def ocr_paragraphs(spark, d):
    spaced = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(paragraphs.recognised_paragraphs(spaced)).alias("pos", "paragraph"))


@query("encoding_corruption", r"""
WITH s AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), 'th', chr(65533)), '[\s\x0B\x1C-\x1F]', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^\x{FFFD}\x00-\x1F\x{E000}-\x{F8FF}]', '', 'g')) / length(t) END AS ratio FROM s""")
def encoding_corruption(spark, d):
    damaged = table(spark, d, "documents").withColumn("text", F.replace(F.col("text"), F.lit("th"), F.lit("�")))
    return damaged.select("doc_id", paragraphs.corruption(F.col("text")).alias("ratio"))


def _chars(spark, d):
    """Characters of the benchmark's texts, ten texts a document, with fonts, places and turned ones made from them."""
    b = table(spark, d, "benchmark").where("text is not null")
    own = b.select((F.col("item_id") / 10).cast("int").cast("string").alias("doc_id"), F.col("item_id").cast("int").alias("page_number"), F.posexplode(F.split("text", "")).alias("pos", "text")).where("text <> ''")
    return own.selectExpr(
        "*",
        "case when text in ('z', 'v', 'w') and page_number % 3 = 0 then 'ABCDEF+CMMI10' else 'Times' end as fontname",
        "cast(10 + (pos div 60) % 4 * 3 as double) as size",
        "cast((pos div 60) * 12 as double) as top",
        "cast((pos div 9) * 10 as double) as x0",
        "case when pos % 9 < 4 then array(0.0D, 1.0D, -1.0D, 0.0D) else array(1.0D, 0.0D, 0.0D, 1.0D) end as matrix",
    )


_CHARS = """chars AS (SELECT CAST(CAST(floor(item_id / 10) AS INTEGER) AS VARCHAR) AS doc_id, CAST(item_id AS INTEGER) AS page_number, pos, substr(text, pos + 1, 1) AS ch
  FROM (SELECT item_id, text, unnest(range(0, length(text))) AS pos FROM benchmark WHERE text IS NOT NULL))"""


@query("math_density", f"""WITH {_CHARS},
m AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (WHERE ch IN ('z', 'v', 'w') AND page_number % 3 = 0 OR regexp_matches(ch, '^[\\x{{2200}}-\\x{{22FF}}\\x{{1D400}}-\\x{{1D7FF}}\\x{{2100}}-\\x{{214F}}]')) AS k FROM chars GROUP BY 1, 2)
SELECT doc_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages FROM m WHERE k >= 3 AND k / n >= 0.002 GROUP BY 1""")
def math_density(spark, d):
    return paragraphs.math_pages(_chars(spark, d)).select("doc_id", F.array_join("pages", ",").alias("pages"))


@query("line_fonts", f"""WITH {_CHARS}
SELECT doc_id, page_number, CAST((pos // 60) * 12 AS INTEGER) AS bucket, CAST(max(10 + (pos // 60) % 4 * 3) AS DOUBLE) AS size FROM chars GROUP BY 1, 2, 3""")
def line_fonts(spark, d):
    return paragraphs.line_fonts(_chars(spark, d))


def _text_lines(spark, d):
    b = table(spark, d, "benchmark").where("text is not null")
    cut = F.filter(F.transform(F.split("text", r"[.\n]"), T.strip), lambda x: x != "")
    return b.select((F.col("item_id") / 10).cast("int").cast("string").alias("doc_id"), F.col("item_id").cast("int").alias("page_number"), F.posexplode(cut).alias("pos", "text"))


@query("heading_promotion", f"""WITH {_CHARS},
fonts AS (SELECT doc_id, page_number, list(size ORDER BY bucket) AS sizes, list_sort(list(size)) AS sorted
          FROM (SELECT doc_id, page_number, (pos // 60) * 12 AS bucket, max(10 + (pos // 60) % 4 * 3) AS size FROM chars GROUP BY 1, 2, 3) GROUP BY 1, 2),
l AS (SELECT item_id, i, trim(x) AS x FROM (SELECT item_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT item_id, regexp_split_to_array(text, '[.\\n]') AS s FROM benchmark WHERE text IS NOT NULL)) WHERE trim(x) <> ''),
ln AS (SELECT CAST(CAST(floor(item_id / 10) AS INTEGER) AS VARCHAR) AS doc_id, CAST(item_id AS INTEGER) AS page_number, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS pos, x AS text FROM l),
r AS (SELECT ln.*, sizes[least(pos + 1, len(sizes))] AS size, sorted[len(sorted) // 2 + 1] AS med FROM ln LEFT JOIN fonts USING (doc_id, page_number))
SELECT doc_id, page_number, pos, text, CASE WHEN size >= med * 1.4 AND length(text) <= 120 AND NOT regexp_matches(text, '^\\d+$') THEN CASE WHEN size / med >= 2 THEN 1 WHEN size / med >= 1.6 THEN 2 ELSE 3 END END AS level FROM r""")
def heading_promotion(spark, d):
    return paragraphs.promoted_headings(_text_lines(spark, d), paragraphs.line_fonts(_chars(spark, d)))


@query("rotated_runs", f"""WITH {_CHARS}
SELECT doc_id, page_number, string_agg(ch, '' ORDER BY pos) AS wrong, reverse(string_agg(ch, '' ORDER BY pos)) AS "right" FROM chars WHERE pos % 9 < 4 GROUP BY doc_id, page_number, pos // 9 HAVING count(*) >= 2""")
def rotated_runs(spark, d):
    return paragraphs.rotated_runs(_chars(spark, d)).select("doc_id", "page_number", "wrong", "right")


@query("doc_word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+')) AS INTEGER) AS words FROM documents")
def doc_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("page_word_count", r"SELECT page_id, CAST(nullif(len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[^\s\x0B]+')), 0) AS INTEGER) AS words FROM pages")
def page_word_count(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(T.word_count(T.strip_tags(F.col("html"))), F.lit(0)).alias("words"))


_MD = "'# ' || source || chr(10) || chr(10) || '- ' || replace(coalesce(text, ''), chr(10), chr(10) || '- ') || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '2. two' ELSE '|:--|' END"


def _marked(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "source", "coalesce(text, '') as text", """concat('# ', source, '\n\n- ', replace(coalesce(text, ''), '\n', '\n- '), '\n| --- | --- |\n', case when doc_id % 2 = 0 then '2. two' else '|:--|' end) as md""")


_COUNTS = r"""len(regexp_extract_all(md, '(?m)^#{1,6} .+')) AS h, len(regexp_extract_all(md, '(?m)^[\-\*\+] .+|^\d+\. .+')) AS l, len(regexp_extract_all(md, '(?m)^\|[-| :]+\|$')) AS t"""


@query("md_element_counts", f"SELECT doc_id, CAST(h AS INTEGER) AS md_headings, CAST(l AS INTEGER) AS md_lists, CAST(t AS INTEGER) AS md_tables FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, {_MD} AS md FROM documents))")
def md_element_counts(spark, d):
    m = _marked(spark, d)
    return m.select("doc_id", *[c.cast("int").alias(k) for k, c in quality.markdown_counts(F.col("md")).items()])


@query("token_ratio_score", rf"""
WITH m AS (SELECT doc_id, {_MD} AS md, len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+')) AS wc FROM documents),
c AS (SELECT doc_id, wc, {_COUNTS}, len(regexp_extract_all(md, '[^\s\x0B\x1C-\x1F]+')) AS mw FROM m),
s AS (SELECT doc_id, least(h / 2.0::DOUBLE, 1.0) AS hs, least(t / 1.0::DOUBLE, 1.0) AS ts, least(l / 5.0::DOUBLE, 1.0) AS ls,
             CASE WHEN wc > 0 THEN greatest(1.0::DOUBLE - least(CAST(mw AS DOUBLE) * 1.3::DOUBLE / greatest(CAST(wc AS DOUBLE) * 2.5::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) END AS tr FROM c)
SELECT doc_id, round(tr, 6) AS token_ratio, round(CASE WHEN tr IS NOT NULL THEN hs * 0.25::DOUBLE + ts * 0.25::DOUBLE + ls * 0.15::DOUBLE + tr * 0.20::DOUBLE + 0.15::DOUBLE ELSE hs * 0.3125 + ts * 0.3125 + ls * 0.1875 + 0.1875 END, 6) AS overall FROM s""")
def token_ratio_score(spark, d):
    m = _marked(spark, d)
    s = quality.score_columns(F.col("md"), F.lit(2), F.lit(1), F.lit(5), T.word_count(F.col("text")))
    return m.select("doc_id", F.round(s["token_ratio"], 6).alias("token_ratio"), F.round(s["overall_raw"], 6).alias("overall"))


@query("scanned_predicate", r"""
SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+'))) AS BIGINT) AS words, count(*) AS pages,
       sum(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+'))) / count(*) < 5 AS scanned FROM documents GROUP BY source""")
def scanned_predicate(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("doc_id"), "text")
    return paragraphs.scanned_documents(pages).withColumnRenamed("doc_id", "source")


def _pages(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("source"), F.lit(".html").alias("ext"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return parse_sources(p)


#: The parts of the driver's pages: a menu, a heading and paragraphs, some all bold and never closed.
_DECODED = "replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_PARTS = rf"""
parts AS (SELECT page_id, CAST(page_id AS VARCHAR) AS doc_id, html, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art FROM pages),
li AS (SELECT doc_id, html, list_transform(regexp_extract_all(nav, '<li><a href="[^"]*">[^<]*'), lambda x: regexp_extract(x, 'href="([^"]*)', 1)) AS href,
              list_transform(regexp_extract_all(nav, '<li><a href="[^"]*">[^<]*'), lambda x: {_DECODED.format("regexp_extract(x, '>([^<>]*)$', 1)")}) AS label FROM parts),
ps AS (SELECT doc_id, {_DECODED.format("regexp_extract(art, '<h1>([^<]*)', 1)")} AS h1,
              list_filter(list_transform(regexp_extract_all(art, '<p>(?:<b>)?[^<]*'), lambda x: {{'bold': starts_with(x, '<p><b>'), 'text': {_DECODED.format("regexp_replace(x, '^<p>(<b>)?', '')")}}}), lambda x: trim(x.text) <> '') AS paras FROM parts),
page AS (SELECT * FROM li JOIN ps USING (doc_id))"""
_MD_PARAS = r"array_to_string(list_transform(paras, lambda x: CASE WHEN x.bold THEN '**' || replace(x.text, '|', '\|') || '**' ELSE replace(x.text, '|', '\|') END), chr(10) || chr(10))"
_MD_NAV = r"array_to_string(list_transform(list_zip(label, href), lambda x: '- [' || replace(x[1], '|', '\|') || '](' || x[2] || ')'), chr(10))"
_MD_STORY = rf"'# ' || replace(h1, '|', '\|') || chr(10) || chr(10) || {_MD_PARAS}"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("page_node_counts", """
SELECT CAST(page_id AS VARCHAR) AS doc_id, (length(html) - length(replace(html, '<h1>', ''))) // 4 AS headings, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs,
       (length(html) - length(replace(html, '<ul>', ''))) // 4 AS lists, (length(html) - length(replace(html, '<li>', ''))) // 4 AS items FROM pages""")
def page_node_counts(spark, d):
    n = nodes_of(_pages(spark, d))
    count = lambda k: F.count_if(F.col("type") == k)
    return n.groupBy("doc_id").agg(count("heading").alias("headings"), count("paragraph").alias("paragraphs"), count("list").alias("lists"), F.coalesce(F.sum(F.when(F.col("type") == "list", F.size("items"))), F.lit(0)).alias("items"))


@query("page_markdown", f"WITH {_PARTS} SELECT doc_id, {_MD_NAV} || chr(10) || chr(10) || {_MD_STORY} AS markdown FROM page")
def page_markdown(spark, d):
    return _pages(spark, d).select("doc_id", render.markdown_of(F.col("nodes")).alias("markdown"))


@query("page_sections", f"WITH {_PARTS} SELECT doc_id, 0 AS section, {_MD_NAV} AS markdown FROM page UNION ALL SELECT doc_id, 1, {_MD_STORY} FROM page")
def page_sections(spark, d):
    return render.section_markdown(nodes_of(_pages(spark, d)))


@query("page_html", f"""WITH {_PARTS}
SELECT doc_id, '<ul>' || chr(10) || array_to_string(list_transform(list_zip(label, href), lambda x: '<li><a href="' || {_ESC.format('x[2]')} || '">' || {_ESC.format('x[1]')} || '</a></li>'), chr(10)) || chr(10) || '</ul>' || chr(10) ||
       '<h1>' || {_ESC.format('h1')} || '</h1>' || chr(10) || array_to_string(list_transform(paras, lambda x: '<p>' || CASE WHEN x.bold THEN '<strong>' ELSE '' END || {_ESC.format('x.text')} || CASE WHEN x.bold THEN '</strong>' ELSE '' END || '</p>'), chr(10)) AS html FROM page""")
def page_html(spark, d):
    return _pages(spark, d).select("doc_id", render.html_of(F.col("nodes")).alias("html"))


@query("page_json", f"""WITH {_PARTS}
SELECT doc_id, '{{"nodes":[{{"type":"list","ordered":false,"items":[' || array_to_string(list_transform(list_zip(label, href), lambda x: '{{"content":' || CAST(to_json('[' || x[1] || '](' || x[2] || ')') AS VARCHAR) || '}}'), ',') || ']}},' ||
       '{{"type":"heading","level":1,"content":' || CAST(to_json(h1) AS VARCHAR) || '}},' || array_to_string(list_transform(paras, lambda x: '{{"type":"paragraph","content":' || CAST(to_json(CASE WHEN x.bold THEN '**' || x.text || '**' ELSE x.text END) AS VARCHAR) || '}}'), ',') ||
       '],"title":' || CAST(to_json(trim({_DECODED.format("regexp_extract(html, '<title>([^<]*)', 1)")})) AS VARCHAR) || ',"format":"html"}}' AS json FROM page""")
def page_json(spark, d):
    return _pages(spark, d).select("doc_id", render.json_of(F.col("nodes"), F.col("metadata")).alias("json"))


@query("chunks_pages", f"""WITH RECURSIVE {_PARTS},
t AS (SELECT doc_id, replace(h1, '|', '\\|') AS head, list_transform(paras, lambda x: CASE WHEN x.bold THEN '**' || replace(x.text, '|', '\\|') || '**' ELSE replace(x.text, '|', '\\|') END) AS ps, {_MD_NAV} AS nav FROM page),
m AS (SELECT doc_id, '# ' || head || chr(10) || chr(10) AS prefix, ps, (length('# ' || head) + 2 + length(array_to_string(ps, chr(10) || chr(10)))) // 4 <= 800 AS whole FROM t),
f(doc_id, n, bin, cur) AS (
  SELECT doc_id, 1, 0, length(prefix) // 4 + length(ps[1]) // 4 FROM m WHERE len(ps) > 0
  UNION ALL
  SELECT f.doc_id, f.n + 1, CASE WHEN NOT whole AND f.cur + length(ps[f.n + 1]) // 4 > 800 THEN f.bin + 1 ELSE f.bin END,
         CASE WHEN NOT whole AND f.cur + length(ps[f.n + 1]) // 4 > 800 THEN length(ps[f.n + 1]) // 4 ELSE f.cur + length(ps[f.n + 1]) // 4 END
  FROM f JOIN m ON m.doc_id = f.doc_id WHERE f.n < len(ps)),
c AS (SELECT doc_id, bin + 1 AS no, CASE WHEN bin = 0 THEN any_value(prefix) ELSE '' END || string_agg(ps[n], chr(10) || chr(10) ORDER BY n) AS content FROM f JOIN m USING (doc_id) GROUP BY doc_id, bin
      UNION ALL SELECT doc_id, 1, trim(prefix, chr(10)) FROM m WHERE len(ps) = 0
      UNION ALL SELECT doc_id, 0, nav FROM t)
SELECT c.doc_id, substr(md5(url), 1, 8) || '_' || lpad(CAST(no AS VARCHAR), 4, '0') AS chunk_id, 'section' AS type, CASE WHEN no = 0 THEN '' ELSE head END AS heading_path, content, url AS source_document, 'html' AS source_format, CAST(length(content) // 4 AS INTEGER) AS token_count
FROM c JOIN t USING (doc_id) JOIN pages ON CAST(page_id AS VARCHAR) = c.doc_id""")
def page_chunks(spark, d):
    return chunking.chunks_of(_pages(spark, d))


@query("page_quality", rf"""WITH {_PARTS},
q AS (SELECT doc_id, {_MD_NAV} || chr(10) || chr(10) || {_MD_STORY} AS md, len(href) AS items, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\s\x0B]+')) AS wc FROM page),
c AS (SELECT doc_id, items, wc, len(regexp_extract_all(md, '[^\s\x0B\x1C-\x1F]+')) AS mw, {_COUNTS} FROM q),
s AS (SELECT doc_id, least(h / 1::DOUBLE, 1.0) AS hs, 1.0::DOUBLE AS ts, least(l / items::DOUBLE, 1.0) AS ls, greatest(1.0::DOUBLE - least(CAST(mw AS DOUBLE) * 1.3::DOUBLE / greatest(wc * 2.5::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS tr FROM c),
o AS (SELECT *, hs * 0.25::DOUBLE + ts * 0.25::DOUBLE + ls * 0.15::DOUBLE + tr * 0.20::DOUBLE + 0.15::DOUBLE AS x FROM s)
SELECT doc_id, round_even(x, 3) AS overall, round_even(hs, 3) AS heading_preservation, ts AS table_preservation, round_even(ls, 3) AS list_preservation, round_even(tr, 3) AS token_reduction_ratio,
       true AS valid_markdown, '' AS warnings, CAST(NULL AS VARCHAR) AS error, round_even(x, 3) >= 0.7 AS passed, true AS has_any_text FROM o""")
def page_quality(spark, d):
    p = _pages(spark, d).withColumn("markdown", render.markdown_of(F.col("nodes")))
    return quality.quality_of(p).withColumn("warnings", F.array_join("warnings", "; "))


@query("page_main_content", f"WITH {_PARTS} SELECT doc_id, {_MD_STORY} AS markdown FROM page")
def page_main_content(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("source"), F.lit(".html").alias("ext"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return parse_sources(p, options={"extract_content": True}).select("doc_id", render.markdown_of(F.col("nodes")).alias("markdown"))


@query("front_matter", """
SELECT c_custkey, '---' || chr(10) || 'title: ''' || c_name || '''' || chr(10) || 'keywords: [''' || c_mktsegment || ''', ''x'']' || chr(10) ||
       CASE WHEN c_nationkey % 2 = 0 THEN 'source_format: csv' || chr(10) ELSE '' END || 'page_count: ' || c_nationkey || chr(10) || '---' AS front FROM customer""")
def front_matter(spark, d):
    meta = F.struct(
        F.col("c_name").alias("title"), *[F.lit(None).cast("string").alias(x) for x in ("author", "subject", "description")], F.array("c_mktsegment", F.lit("x")).alias("keywords"),
        *[F.lit(None).cast("string").alias(x) for x in ("created_at", "modified_at")], F.when(F.col("c_nationkey") % 2 == 0, "csv").alias("source_format"), F.col("c_nationkey").alias("page_count"),
        *[F.lit(None).cast("int").alias(x) for x in ("slide_count", "sheet_count", "word_count")],
    )
    return table(spark, d, "customer").withColumn("meta", meta).select("c_custkey", render.front_matter(F.col("meta")).alias("front"))


@query("pdf_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M') || ':' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%S') ELSE '00' END ||
       CASE o_orderkey % 4 WHEN 0 THEN '-08:00' ELSE '+00:00' END AS iso FROM orders""")
def pdf_dates(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmm"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "ss")).otherwise(""), F.expr("case o_orderkey % 4 when 0 then \"-08'00'\" when 1 then 'Z' else '' end"))
    return o.select("o_orderkey", T.pdf_date(raw).alias("iso"))


@query("header_dates", "SELECT o_orderkey, CASE WHEN day(o_orderdate) = 1 AND strftime(o_orderdate, '%H%M%S') = '000000' THEN strftime(o_orderdate, '%b %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS head FROM orders")
def header_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.header_date(F.col("o_orderdate")).alias("head"))

"""Queries on grids, records and images, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import json as J
from folioflow.functions import text as T
from folioflow.operators import images, tables
from folioflow.plans import render
from folioflow.plans.catalog_text import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("table_gfm_rows", """
SELECT l_orderkey, '| line | flag | status |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
       string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' | ' || l_linestatus || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS markdown FROM lineitem GROUP BY l_orderkey""")
def table_gfm_rows(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    body = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_returnflag"], x["l_linestatus"]))
    return own.select("l_orderkey", render.gfm_from_grid(F.concat(F.array(F.array(F.lit("line"), F.lit("flag"), F.lit("status"))), body)).alias("markdown"))


@query("table_truncation", """
SELECT o_custkey, o_orderkey, n > 5 AS truncated, CASE WHEN n > 5 THEN CAST(n AS INTEGER) END AS total_rows
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 5""")
def table_truncation(spark, d):
    return tables.cap_rows(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ("o_custkey",), "o_orderkey", 5)


_CELLS = """cells AS (
  SELECT ps AS doc_id, rn AS "row", c AS col, CASE WHEN c = 0 THEN CASE WHEN rn % 3 = 0 THEN '' ELSE p_name END WHEN c = 1 THEN CASE WHEN ps % 2 = 0 THEN ' ' ELSE p_brand END WHEN c = 2 THEN CASE WHEN ps % 3 = 0 THEN '' ELSE p_type END ELSE '' END AS value
  FROM (SELECT p_size AS ps, p_name, p_brand, p_type, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM part), (SELECT unnest([0, 1, 2, 3]) AS c))"""


def _cells(spark, d):
    p = table(spark, d, "part").selectExpr("p_size as doc_id", "p_name", "p_brand", "p_type", "row_number() over (partition by p_size order by p_partkey) as row")
    values = F.expr("array(if(row % 3 = 0, '', p_name), if(doc_id % 2 = 0, ' ', p_brand), if(doc_id % 3 = 0, '', p_type), '')")
    return p.select("doc_id", F.lit("s").alias("sheet"), "row", F.posexplode(values).alias("col", "value"))


@query("trailing_trim", f"""WITH {_CELLS},
r AS (SELECT doc_id, max("row") AS last_row FROM cells WHERE value <> '' GROUP BY 1),
k AS (SELECT cells.* FROM cells JOIN r USING (doc_id) WHERE "row" <= last_row),
s AS (SELECT doc_id, max(col) AS last_col FROM k WHERE trim(value) <> '' GROUP BY 1)
SELECT k.doc_id, k."row", k.col, k.value FROM k JOIN s USING (doc_id) WHERE k.col <= last_col""")
def trailing_trim(spark, d):
    return tables.trim(_cells(spark, d)).drop("sheet")


@query("table_plausibility", """
WITH c AS (SELECT conv_id AS table_id, turn AS "row", unnest([0, 1, 2]) AS col, unnest([CASE WHEN turn % 2 = 0 OR conv_id % 3 = 0 THEN '' ELSE role END, CASE WHEN conv_id % 2 = 0 THEN substr(text, 1, 30) ELSE text END, CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE '' END]) AS value FROM conversations),
f AS (SELECT *, trim(coalesce(value, '')) <> '' AS filled FROM c),
rw AS (SELECT table_id, "row", count(*) FILTER (WHERE filled) AS n, sum(CASE WHEN filled THEN length(value) END) AS sz FROM f GROUP BY 1, 2),
st AS (SELECT table_id, min(CASE WHEN n > 1 THEN "row" END) AS start FROM rw GROUP BY 1),
ld AS (SELECT table_id, sum(sz) / sum(n) AS lead FROM rw JOIN st USING (table_id) WHERE "row" < start GROUP BY 1),
k AS (SELECT f.* FROM f JOIN st USING (table_id) LEFT JOIN ld USING (table_id) WHERE NOT coalesce(lead > 80 AND "row" < start, false)),
sh AS (SELECT table_id, max(col) + 1 AS width, count(*) FILTER (WHERE filled) AS n, count(DISTINCT CASE WHEN filled THEN col END) AS cols, coalesce(sum(CASE WHEN filled THEN length(value) END), 0) AS sz FROM k GROUP BY 1)
SELECT k.table_id, k."row", k.col, k.value FROM k JOIN sh USING (table_id)
WHERE n > 0 AND NOT (width - cols) * 2 > width AND NOT (cols = 1 AND sz + n - 1 > 200) AND NOT (width <= 3 AND sz > 80 * n)""")
def table_plausibility(spark, d):
    c = table(spark, d, "conversations")
    values = F.expr("array(if(turn % 2 = 0 or conv_id % 3 = 0, '', role), if(conv_id % 2 = 0, substr(text, 1, 30), text), if(conv_id % 5 = 0, 'x', ''))")
    return tables.plausible_rows(c.select(F.col("conv_id").alias("table_id"), F.col("turn").alias("row"), F.posexplode(values).alias("col", "value")))


@query("merged_cell_fill", f"""WITH {_CELLS},
m AS (SELECT DISTINCT doc_id, 2 AS r0, 3 AS r1, 0 AS c0, 1 AS c1 FROM cells WHERE doc_id % 2 = 1)
SELECT c.doc_id, c."row", c.col, CASE WHEN m.doc_id IS NULL THEN c.value ELSE a.value END AS value FROM cells c
LEFT JOIN m ON c.doc_id = m.doc_id AND c."row" BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 LEFT JOIN cells a ON a.doc_id = m.doc_id AND a."row" = r0 AND a.col = c0""")
def merged_cell_fill(spark, d):
    cells = _cells(spark, d)
    merges = cells.where("doc_id % 2 = 1").select("doc_id", "sheet").distinct().selectExpr("*", "2 as min_row", "3 as max_row", "0 as min_col", "1 as max_col")
    return tables.fill_merged(cells, merges).drop("sheet")


@query("json_flat_kv", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS INTEGER) AS pos, key, value FROM (
  SELECT event_id, 1 AS o, 'type' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 2, 'k', CAST(json_extract_string(props, '$.k') AS VARCHAR) FROM events)""")
def json_flat_kv(spark, d):
    e = table(spark, d, "events").withColumn("j", F.concat(F.lit('{"type":"'), "event_type", F.lit('",'), F.expr("substring(props, 2)")))
    return J.flat_pairs(e, "event_id", "j")


_KINDS = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',' || props || ']' WHEN 2 THEN '{"properties":{"a":{}},"type":"object"}' WHEN 3 THEN '[1,2]' WHEN 4 THEN '{"a":{"b":1}}' ELSE '{"a":' END"""


@query("json_classify", f"""
SELECT event_id, CASE WHEN NOT json_valid(j) THEN 'invalid' WHEN json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'properties') AND list_contains(json_keys(j), 'type') THEN 'schema'
  WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.a') IS DISTINCT FROM 'OBJECT' THEN 'flat_object' WHEN json_type(j) = 'ARRAY' AND json_type(j, '$[0]') = 'OBJECT' THEN 'array_dump' ELSE 'code' END AS kind
FROM (SELECT event_id, {_KINDS} AS j FROM events)""")
def json_classify(spark, d):
    sql = _KINDS.replace("'[' || props || ',' || props || ']'", "concat('[', props, ',', props, ']')")
    return table(spark, d, "events").select("event_id", J.json_kind(F.expr(sql)).alias("kind"))


_RECORDS = "SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rw, event_type, event_id FROM events"


def _records(spark, d):
    e = table(spark, d, "events").selectExpr("user_id as doc_id", "cast(row_number() over (partition by user_id order by event_id) - 1 as int) as row", "event_type", "event_id")
    return e.select("doc_id", "row", F.posexplode(F.array(F.struct(F.col("event_type").alias("key"), F.lit("1").alias("value")), F.struct(F.lit("id").alias("key"), F.col("event_id").cast("string").alias("value")))).alias("pos", "e")).select("doc_id", "row", "pos", "e.*")


@query("json_array_headers", f"""
SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seen_at) - 1 AS INTEGER) AS place FROM (
  SELECT doc_id, key, min(rw * 2 + pos) AS seen_at FROM (SELECT doc_id, rw, 0 AS pos, event_type AS key FROM ({_RECORDS}) UNION ALL SELECT doc_id, rw, 1, 'id' FROM ({_RECORDS})) GROUP BY 1, 2)""")
def json_array_headers(spark, d):
    return tables.array_headers(_records(spark, d))


@query("json_array_table", f"""
WITH r AS (SELECT doc_id, rw, 0 AS pos, event_type AS key, '1' AS value FROM ({_RECORDS}) UNION ALL SELECT doc_id, rw, 1, 'id', CAST(event_id AS VARCHAR) FROM ({_RECORDS})),
h AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY seen_at) - 1 AS col FROM (SELECT doc_id, key, min(rw * 2 + pos) AS seen_at FROM r GROUP BY 1, 2))
SELECT doc_id, CAST(0 AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, key AS value FROM h UNION ALL
SELECT f.doc_id, CAST(f.rw + 1 AS INTEGER), CAST(h.col AS INTEGER), coalesce(r.value, '') FROM (SELECT DISTINCT doc_id, rw FROM r) f JOIN h ON h.doc_id = f.doc_id LEFT JOIN r ON r.doc_id = f.doc_id AND r.rw = f.rw AND r.key = h.key""")
def json_array_table(spark, d):
    return tables.array_table(_records(spark, d))


_PAGED = "SELECT o_custkey AS doc_id, CAST(o_orderkey % 40 AS INTEGER) AS page, o_orderkey AS table_no, CAST(o_orderkey // 7 % 3 AS INTEGER) AS ncols FROM orders"


@query("cross_page_tables", f"""
WITH p AS ({_PAGED}), g AS (SELECT doc_id, page, arg_max(ncols, table_no) AS last, arg_min(ncols, table_no) AS first FROM p GROUP BY 1, 2)
SELECT a.doc_id, a.page AS page_a, b.page AS page_b, a.last AS ncols FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND b.first = a.last WHERE a.last > 0""")
def cross_page_tables(spark, d):
    return tables.continued_tables(table(spark, d, "orders").selectExpr("o_custkey as doc_id", "cast(o_orderkey % 40 as int) as page", "o_orderkey as table_no", "cast(o_orderkey div 7 % 3 as int) as ncols"))


@query("table_fragments", """
WITH p AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 12 AS INTEGER) AS section, CAST(o_orderkey % 12 + 1 AS INTEGER) AS page, o_orderkey AS table_no, CAST(o_orderkey // 7 % 4 AS INTEGER) AS ncols, o_orderpriority AS header FROM orders),
f AS (SELECT doc_id, section, arg_min(page, table_no) AS page, arg_min(ncols, table_no) AS ncols, arg_min(header, table_no) AS header FROM p GROUP BY 1, 2)
SELECT a.doc_id, a.section AS section_a, b.section AS section_b, a.page AS page_a, b.page AS page_b FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.section = a.section + 1
WHERE b.page = a.page + 1 AND abs(b.ncols - a.ncols) <= 1 AND a.header <> b.header""")
def table_fragments(spark, d):
    p = table(spark, d, "orders").selectExpr("o_custkey as doc_id", "cast(o_orderkey % 12 as int) as section", "cast(o_orderkey % 12 + 1 as int) as page", "o_orderkey as table_no", "cast(o_orderkey div 7 % 4 as int) as ncols", "o_orderpriority as header")
    return tables.section_fragments(p)


@query("formula_cells", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '[formula: =A' || p_size || ']' ELSE p_brand END AS value FROM part")
def formula_cells(spark, d):
    return table(spark, d, "part").select("p_partkey", T.formula(F.expr("if(p_size % 3 = 0, concat('=A', p_size), p_brand)")).alias("value"))


@query("pipe_table_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || '/' || l_linestatus AS cells FROM lineitem""")
def pipe_table_rows(spark, d):
    text = F.concat(F.lit("| a | b |\n| --- | :-: |\n| "), "l_returnflag", F.lit(" |"), "l_linestatus", F.lit("|"))
    own = tables.parse_pipe_tables(table(spark, d, "lineitem").withColumn("text", text))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.element_at("rows", 2), "/").alias("cells"))


@query("image_classify", """
SELECT p_partkey, CASE WHEN k = 'pptx' AND (w / 100.0 BETWEEN 0.85 AND 1.05 AND h / 100.0 BETWEEN 0.85 AND 1.05 OR w / h > 15 OR w / h < 0.067 OR w < 5 AND h < 5 OR n LIKE 'rule\\_%' ESCAPE '\\' OR n LIKE 'background%')
  OR k = 'pdf' AND (w >= 85 AND h >= 85 OR w / h > 15 OR w / h < 0.067 OR w < 5 AND h < 5) OR k = 'docx' AND (n LIKE 'rule\\_%' ESCAPE '\\' OR n LIKE 'background%') THEN 'decorative' ELSE 'unknown' END AS kind
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pptx' WHEN 1 THEN 'pdf' ELSE 'docx' END AS k, CAST(p_size * 2 + 1 AS DOUBLE) AS w, CAST(p_partkey % 97 + 1 AS DOUBLE) AS h,
  CASE p_partkey % 5 WHEN 0 THEN 'rule_' || p_brand WHEN 1 THEN 'background' ELSE p_name END AS n FROM part)""")
def image_classify(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then 'pptx' when 1 then 'pdf' else 'docx' end as k", "double(p_size * 2 + 1) as w", "double(p_partkey % 97 + 1) as h", "case p_partkey % 5 when 0 then concat('Rule_', p_brand) when 1 then 'Background' else p_name end as n")
    return p.select("p_partkey", images.image_kind(F.col("k"), F.col("w"), F.col("h"), F.lit(100.0), F.lit(100.0), F.col("n"), F.col("n")).alias("kind"))

"""Queries that parse formats other than pages; their inputs are made from the driver's tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from folioflow.operators.tables import grids
from folioflow.plans import render
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


def sources(rows, ext, text):
    return rows.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(ext).alias("ext"), F.encode(text, "utf-8").alias("content"))


def spread(rows, key):
    """Narrow rows dealt out anew: a small file that is one task of a scan can make many documents."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _cells(nodes):
    """(doc_id, section, row, col, value) of all tables."""
    t = nodes.where("type = 'table'").select("doc_id", "section", F.posexplode(render.table_grid(F.col("table"), render.run_json)).alias("row", "cells"))
    return t.select("doc_id", "section", "row", F.posexplode("cells").alias("col", "value"))


@query("csv_tables", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT doc_id, CAST(r AS INTEGER) AS "row", unnest([0, 1, 2]) AS col, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM o
UNION ALL SELECT DISTINCT doc_id, 0, unnest([0, 1, 2]), unnest(['key', 'status', 'priority']) FROM o""")
def csv_tables(spark, d):
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.lit(""))
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("﻿key,status,priority,\r\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"), F.lit("\r\n,,,\r\n"))
    return _cells(nodes_of(parse_sources(sources(own, ".csv", text)))).drop("section")


@query("json_tables", """
SELECT CAST(event_id AS VARCHAR) AS doc_id, unnest([0, 0, 1, 1, 2, 2]) AS "row", unnest([0, 1, 0, 1, 0, 1]) AS col, unnest(['Key', 'Value', 'type', event_type, 'k', CAST(json_extract_string(props, '$.k') AS VARCHAR)]) AS value FROM events""")
def json_tables(spark, d):
    e = table(spark, d, "events").withColumn("doc_id", F.col("event_id").cast("string"))
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('",'), F.expr("substring(props, 2)"))
    return _cells(nodes_of(parse_sources(sources(e, ".json", text)))).drop("section")


@query("sql_ddl_columns", """
SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, unnest(['ID', 'AMOUNT', 'NOTE']) AS name, unnest(['INTEGER', 'DECIMAL(10,2)', 'VARCHAR(' || (n_nationkey + 1) || ')']) AS type, unnest(['YES', '', 'YES']) AS not_null, unnest(['', '0', '''x,y''']) AS "default" FROM nation""")
def sql_ddl_columns(spark, d):
    n = table(spark, d, "nation").withColumn("doc_id", F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("-- money\nCREATE TABLE t_"), "doc_id", F.lit(" (ID integer NOT NULL PRIMARY KEY, AMOUNT decimal(10,2) DEFAULT 0, NOTE varchar("), (F.col("n_nationkey") + 1).cast("string"), F.lit(") NOT NULL DEFAULT 'x,y', FOREIGN KEY (ID) REFERENCES u (ID));\nCREATE INDEX i ON t_"), "doc_id", F.lit(" (ID);"))
    cells = _cells(nodes_of(parse_sources(sources(n, ".sql", text))))
    own = grids(cells.where("row > 0"), ("doc_id", "section")).select("doc_id", F.explode("grid").alias("r")).where("size(r) > 0")
    return own.select("doc_id", F.regexp_replace(F.col("r")[0], "`", "").alias("name"), F.col("r")[1].alias("type"), F.col("r")[2].alias("not_null"), F.col("r")[3].alias("default"))


_WSDL = (
    '<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" name="S{0}"><documentation>Service of {1}</documentation><message name="In{0}"><part name="key" type="xsd:int"/></message>'
    '<message name="Out{0}"><part name="name" type="xsd:string"/></message><portType name="P{0}"><operation name="Get{0}"><input message="tns:In{0}"/><output message="tns:Out{0}"/></operation></portType></definitions>'
)


@query("wsdl_operations", """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'S' || n_nationkey AS title, 'Operation: Get' || n_nationkey AS operation, 'Input: In' || n_nationkey || '; Output: Out' || n_nationkey AS ways FROM nation""")
def wsdl_operations(spark, d):
    n = table(spark, d, "nation").withColumn("doc_id", F.col("n_nationkey").cast("string"))
    text = F.replace(F.replace(F.lit(_WSDL), F.lit("{0}"), F.col("doc_id")), F.lit("{1}"), F.col("n_name"))
    parsed = parse_sources(sources(n, ".wsdl", text))
    own = nodes_of(parsed).withColumn("t", render.runs_text(F.col("runs")))
    ops = own.where("path[size(path) - 1] like 'Operation%'").groupBy("doc_id").agg(F.max(F.when(F.col("type") == "heading", F.col("t"))).alias("operation"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "paragraph", F.struct("node_id", "t")))), lambda x: x["t"]), "; ").alias("ways"))
    return documents_of(parsed).select("doc_id", F.col("metadata.title").alias("title")).join(ops, "doc_id")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def book(title: str, pages: list[str]) -> bytes:
    """A small EPUB."""
    items = "".join(f'<item id="p{i}" href="p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(pages)))
    order = "".join(f'<itemref idref="p{i}"/>' for i in reversed(range(len(pages)))) + '<itemref idref="gone"/>'
    package = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></metadata><manifest>{items}</manifest><spine>{order}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    return _zipped({"META-INF/container.xml": container, "OEBPS/content.opf": package} | {f"OEBPS/p{i}.xhtml": p for i, p in enumerate(pages)})


@query("epub_spine", "SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, r_name AS title, 'c2,c1,c0' AS headings, CAST(9 AS INTEGER) AS words FROM region")
def epub_spine(spark, d):
    make = F.udf(lambda t: book(t, [f"<html><body><h1>c{i}</h1><p>two words</p></body></html>" for i in range(3)]), "binary")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(".epub").alias("ext"), make("r_name").alias("content"))
    parsed = parse_sources(r)
    heads = nodes_of(parsed).where("type = 'heading'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", render.runs_text(F.col("runs")).alias("t")))), lambda x: x["t"]), ",").alias("headings"))
    return documents_of(parsed).select("doc_id", F.col("metadata.title").alias("title"), F.col("metadata.word_count").alias("words")).join(heads, "doc_id")


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets: dict[str, str]) -> bytes:
    """A small workbook from the XML of its sheets' rows (and what follows them)."""
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f"<workbook {_MAIN}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'}
    return _zipped(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet {_MAIN}>{x}</worksheet>" for i, x in enumerate(sheets.values(), 1)})


@query("xlsx_cells", """
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, unnest([0, 0, 1, 1, 2, 2]) AS "row", unnest([0, 1, 0, 1, 0, 1]) AS col, unnest(['name', 'nation', s_name, CAST(s_nationkey AS VARCHAR), 'both', 'both']) AS value FROM supplier""")
def xlsx_cells(spark, d):
    def make(name, nation):
        text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
        rows = f'<sheetData><row r="1">{text("A1", "name")}{text("B1", "nation")}</row><row r="2">{text("A2", name)}<c r="B2"><v>{nation}</v></c></row><row r="3">{text("A3", "both")}</row><row r="5">{text("D5", "")}</row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells>'
        return workbook({"Sheet1": rows, "Empty": "<sheetData/>"})

    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(".xlsx").alias("ext"), F.udf(make, "binary")("s_name", "s_nationkey").alias("content"))
    return _cells(nodes_of(parse_sources(s))).drop("section")

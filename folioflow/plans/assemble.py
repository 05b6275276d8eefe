"""Nodes out of rows that other systems extract: pages of text with tables, and transcripts.

Everything here is a DataFrame plan; a document's nodes are numbered by one window on its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import has_text, strip
from folioflow.operators.tables import cap_rows, grids, plausible_rows
from folioflow.operators.transcript import silence_sections, turn_markdown
from folioflow.schema import MAX_TABLE_ROWS, RUNS, TABLE

_FIELDS = {"level": "int", "page": "int", "quote": "int", "runs": RUNS, "table": TABLE, "items": None, "code": "string", "language": "string", "image": None}


def text_runs(text: Column, bold: bool = False) -> Column:
    """One run of a text."""
    f = F.lit(False)
    return F.array(F.struct(text.alias("text"), F.lit(bold).alias("bold"), f.alias("italic"), f.alias("code"), f.alias("strike"), F.lit(None).cast("string").alias("href")))


def table_of(grid: Column, truncated: Column | None = None, total: Column | None = None) -> Column:
    """A table of cell texts, its first row the header."""
    cell = lambda c, head: F.struct(F.array(text_runs(c)).alias("parts"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), head.alias("header"))
    rows = F.transform(grid, lambda row, i: F.transform(row, lambda c: cell(c, i == 0)))
    no = F.lit(False)
    return F.struct(F.lit(None).cast("string").alias("caption"), (F.coalesce(truncated, no) if truncated is not None else no).alias("truncated"), (total if total is not None else F.lit(None)).cast("int").alias("total_rows"), no.alias("merged"), no.alias("complex"), rows.alias("rows")).cast(TABLE)


def _shaped(rows: DataFrame, **own: Column) -> DataFrame:
    """(doc_id, order columns, type, fields): absent fields are null."""
    from pyspark.sql.types import StructType

    from folioflow.schema import NODE_FIELDS

    kinds = {f.name: f.dataType for f in StructType.fromDDL(NODE_FIELDS).fields}
    return rows.select("doc_id", "o1", "o2", "o3", own.pop("type").alias("type"), *[own.get(k, F.lit(None)).cast(kinds[k]).alias(k) for k in _FIELDS])


def number_nodes(rows: DataFrame) -> DataFrame:
    """Node ids, sections and paths of rows in the order (o1, o2, o3); a heading opens a section below no other."""
    from folioflow.plans.render import runs_text

    over = "partition by doc_id order by o1, o2, o3"
    out = rows.selectExpr("*", f"cast(row_number() over ({over}) - 1 as int) as node_id", f"cast(sum(if(type = 'heading', 1, 0)) over ({over} rows unbounded preceding) as int) as opened")
    first = F.expr(f"first(type) over ({over})")
    out = out.withColumn("section", F.col("opened") - F.when(first == "heading", 1).otherwise(0))
    title = F.expr(f"last(if(type = 'heading', title, null), true) over ({over} rows unbounded preceding)")
    out = out.withColumn("title", runs_text(F.col("runs"))).withColumn("path", F.array_compact(F.array(title)))
    return out.select("doc_id", "node_id", "section", "type", "level", "path", *[k for k in _FIELDS if k != "level"])


def page_nodes(lines: DataFrame, cells: DataFrame | None = None, max_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """Nodes of pages: a heading "Page N", the page's plausible tables, then its lines.

    ``lines`` has (doc_id, page_number, pos, text) and maybe ``level``, of lines that head a section;
    ``cells`` has (doc_id, page_number, table_no, row, col, value). A page with neither has no heading."""
    lines = lines if "level" in lines.columns else lines.withColumn("level", F.lit(None).cast("int"))
    base = lines.where(has_text(F.col("text"))).select("doc_id", F.col("page_number").alias("o1"), F.lit(2).alias("o2"), F.col("pos").cast("long").alias("o3"), "text", F.col("level").alias("lv"))
    page = F.col("o1").cast("int")
    parts = _shaped(base, type=F.when(F.col("lv").isNull(), "paragraph").otherwise("heading"), level=F.col("lv"), page=page, runs=text_runs(strip(F.col("text"))))
    if cells is not None:
        keyed = cells.withColumn("table_id", F.struct("doc_id", "page_number", "table_no"))
        good = plausible_rows(keyed.select("table_id", "row", "col", "value"))
        rows = grids(good, ("table_id",)).select("table_id", F.posexplode("grid").alias("row", "cells"))
        kept = cap_rows(rows, ("table_id",), "row", max_rows).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.transform(r["cells"], strip)).alias("grid"), F.bool_or("truncated").alias("truncated"), F.max("total_rows").alias("total"))
        tables = kept.select(F.col("table_id.doc_id").alias("doc_id"), F.col("table_id.page_number").alias("o1"), F.lit(1).alias("o2"), F.col("table_id.table_no").cast("long").alias("o3"), "grid", "truncated", "total")
        parts = parts.unionByName(_shaped(tables, type=F.lit("table"), page=page, table=table_of(F.col("grid"), F.col("truncated"), F.col("total"))))
    # the first part of a page brings the heading along, so what gives the lines runs once
    over = "over (partition by doc_id order by o1, o2, o3)"
    first = F.expr(f"row_number() {over} = 1 or not (lag(o1) {over} <=> o1)")
    head = {"o2": F.lit(0), "o3": F.lit(0).cast("long"), "type": F.lit("heading"), "level": F.lit(2), "page": page, "runs": text_runs(F.concat(F.lit("Page "), F.col("o1").cast("string")))}
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    names = [c for c in parts.columns if c != "doc_id"]
    opening = F.struct(*[F.col(c) if c == "o1" else head.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    return number_nodes(parts.withColumn("first", first).select("doc_id", F.inline(F.when(F.col("first"), F.array(opening, F.struct(*names))).otherwise(F.array(F.struct(*names))))))


def transcript_nodes(segments: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Nodes of transcripts: a title, a paragraph a turn, and a timed heading after each long silence.

    ``titles`` has (doc_id, title); without one the document's id heads it. Nothing spoken gives one paragraph that says so."""
    own = silence_sections(segments).select("doc_id", "seg_no", "section", "heading")
    lines = turn_markdown(segments).select("doc_id", "seg_no", "line").join(own, ["doc_id", "seg_no"])
    turns = _shaped(lines.select("doc_id", F.col("section").alias("o1"), F.lit(1).alias("o2"), F.col("seg_no").cast("long").alias("o3"), "line"), type=F.lit("paragraph"), runs=text_runs(F.col("line")))
    gaps = lines.where("section > 0").select("doc_id", F.col("section").alias("o1"), F.lit(0).alias("o2"), F.lit(0).cast("long").alias("o3"), "heading").distinct()
    gaps = _shaped(gaps, type=F.lit("heading"), level=F.lit(2), runs=text_runs(F.col("heading")))
    all_docs = segments.select("doc_id").distinct()
    named = all_docs.join(titles, "doc_id", "left").select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title")) if titles is not None else all_docs.select("doc_id", F.col("doc_id").cast("string").alias("title"))
    at = lambda n: (F.lit(0).alias("o1"), F.lit(n).alias("o2"), F.lit(0).cast("long").alias("o3"))
    tops = _shaped(named.select("doc_id", *at(0), "title"), type=F.lit("heading"), level=F.lit(1), runs=text_runs(F.col("title")))
    silent = all_docs.join(own.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", *at(1))
    silent = _shaped(silent, type=F.lit("paragraph"), runs=text_runs(F.lit("No speech was detected.")))
    return number_nodes(turns.unionByName(gaps).unionByName(tops).unionByName(silent))


def warnings_of(docs: DataFrame, *more: DataFrame) -> DataFrame:
    """(doc_id, channel, seq, type, message, pages, count): warnings with a type, and notes, as one table.

    ``more`` holds further warnings (doc_id, type, message[, pages][, count]) found by operators."""
    typed = docs.select("doc_id", F.lit("warning").alias("channel"), F.posexplode("warnings").alias("seq", "w")).select("doc_id", "channel", "seq", "w.*")
    notes = docs.select("doc_id", F.lit("note").alias("channel"), F.posexplode("notes").alias("seq", "message"))
    out = typed.unionByName(notes, allowMissingColumns=True)
    for m in more:
        kept = [c for c in ("type", "message", "pages", "count") if c in m.columns]
        out = out.unionByName(m.select("doc_id", F.lit("operator").alias("channel"), F.lit(0).alias("seq"), *kept), allowMissingColumns=True)
    return out


def math_warnings(pages: DataFrame) -> DataFrame:
    """Warnings for documents with (doc_id, pages) of mathematical text."""
    return pages.select("doc_id", F.lit("math_detected").alias("type"), F.concat(F.lit("Mathematical text on "), F.size("pages").cast("string"), F.lit(" pages; formulas may be garbled.")).alias("message"), "pages")


def corruption_warnings(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.lit("font_encoding_unsupported").alias("type"), F.lit("Text of some pages could not be decoded.").alias("message"), "pages")


def continuation_warnings(pairs: DataFrame) -> DataFrame:
    """Warnings for tables that go on over pages, (doc_id, page_a, page_b)."""
    own = pairs.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("page_a", "page_b"))))).alias("pages"), F.count("*").cast("int").alias("count"))
    return own.select("doc_id", F.lit("cross_page_table").alias("type"), F.lit("A table may go on over pages.").alias("message"), "pages", "count")


def scanned_warnings(scanned: DataFrame) -> DataFrame:
    return scanned.where("scanned").select("doc_id", F.lit("scanned_content").alias("type"), F.lit("Hardly any text; the pages may be scans.").alias("message"))

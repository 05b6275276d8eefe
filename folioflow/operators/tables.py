"""Operators on grids of cells: plausibility, trimming, caps, merged regions, tables that go on over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import formula, gfm_rows, strip
from folioflow.schema import MAX_TABLE_ROWS

PROSE_CHARS, SINGLE_CHARS, NARROW_COLUMNS = 80, 200, 3


def plausible_rows(grids: DataFrame, table_col: str = "table_id") -> DataFrame:
    """The rows of grids (table_id, row, col, value) that look like tables.

    Prose rows above the first row with two filled cells fall out if their cells are long on average;
    then a grid goes if it is empty, if more than half its columns are, if one column holds a long
    text, or if a narrow grid's cells are long on average."""
    t = table_col
    cells = grids.withColumn("value", F.coalesce("value", F.lit(""))).withColumn("filled", strip(F.col("value")) != "")
    cells = cells.withColumn("size", F.when(F.col("filled"), F.length("value")))
    rows = cells.groupBy(t, "row").agg(F.count_if("filled").alias("filled"), F.sum("size").alias("size"), F.max("col").alias("last"))
    starts = rows.groupBy(t).agg(F.min(F.when(F.col("filled") > 1, F.col("row"))).alias("start"), (F.max("last") + 1).alias("width"))
    lead = rows.join(starts, t).where(F.col("row") < F.col("start")).groupBy(t).agg((F.sum("size") / F.sum("filled")).alias("lead"))
    first = starts.join(lead, t, "left").select(t, F.when((F.col("width") >= 2) & (F.col("lead") > PROSE_CHARS), F.col("start")).alias("start"))
    kept = cells.join(first, t).where(F.col("start").isNull() | (F.col("row") >= F.col("start"))).drop("start")
    shape = kept.groupBy(t).agg(
        (F.max("col") + 1).alias("width"),
        F.count_if("filled").alias("filled"),
        F.count_distinct(F.when(F.col("filled"), F.col("col"))).alias("columns"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
    )
    width, columns, filled, size = (F.col(c) for c in ("width", "columns", "filled", "size"))
    good = (filled > 0) & ~((width - columns) * 2 > width) & ~((columns == 1) & (size + filled - 1 > SINGLE_CHARS)) & ~((width <= NARROW_COLUMNS) & (size > PROSE_CHARS * filled))
    return kept.join(shape.where(good).select(t), t, "left_semi").drop("filled", "size")


def trim(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "sheet")) -> DataFrame:
    """Cells without the empty rows at the end and then the blank columns at the right.

    A row counts as empty if its cells are, a column if its cells are but for white space."""
    ends = cells.groupBy(*keys).agg(F.max(F.when(F.coalesce("value", F.lit("")) != "", F.col("row"))).alias("last_row"))
    rows = cells.join(ends, list(keys)).where(F.col("row") <= F.col("last_row")).drop("last_row")
    sides = rows.groupBy(*keys).agg(F.max(F.when(strip(F.coalesce("value", F.lit(""))) != "", F.col("col"))).alias("last_col"))
    return rows.join(sides, list(keys)).where(F.col("col") <= F.col("last_col")).drop("last_col")


def cap_rows(rows: DataFrame, keys: tuple[str, ...], order: str, most: int = MAX_TABLE_ROWS) -> DataFrame:
    """The first rows of each group; ``truncated`` and ``total_rows`` tell of more. Zero sets no cap."""
    by = ", ".join(keys)
    own = rows.selectExpr("*", f"row_number() over (partition by {by} order by {order}) as place", f"count(*) over (partition by {by}) as n")
    cut = (F.col("n") > most) & F.lit(most > 0)
    return own.where(F.lit(most == 0) | (F.col("place") <= most)).withColumn("truncated", cut).withColumn("total_rows", F.when(cut, F.col("n")).cast("int")).drop("n", "place")


def fill_merged(cells: DataFrame, merges: DataFrame, keys: tuple[str, ...] = ("doc_id", "sheet")) -> DataFrame:
    """Every cell of a merged region takes the value of the region's first cell; regions meet cells row by row."""
    c, m = cells.alias("c"), merges.withColumn("in_row", F.explode(F.sequence("min_row", "max_row"))).alias("m")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"c.{k}") == F.col(f"m.{k}"))
    inside = same & (F.col("c.row") == F.col("m.in_row")) & F.col("c.col").between(F.col("m.min_col"), F.col("m.max_col"))
    joined = c.join(m, inside, "left").select("c.*", F.col("m.min_row").alias("r0"), F.col("m.min_col").alias("c0"))
    anchors = cells.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("row").alias("a_row"), F.col("col").alias("a_col"), F.col("value").alias("anchor"))
    at = (F.col("r0") == F.col("a_row")) & (F.col("c0") == F.col("a_col"))
    for k in keys:
        at = at & (F.col(k) == F.col(f"a_{k}"))
    out = joined.join(anchors, at, "left").withColumn("value", F.when(F.col("r0").isNull(), F.col("value")).otherwise(F.col("anchor")))
    return out.select(*cells.columns)


def annotate_formulas(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", formula(F.col("value")))


def without_formula_cache(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "sheet")) -> DataFrame:
    """Sheets that have formulas of which none has a value."""
    return cells.groupBy(*keys).agg(F.bool_or("is_formula").alias("any"), F.bool_or(F.col("is_formula") & F.col("value").isNotNull()).alias("cached")).where(F.col("any") & ~F.coalesce("cached", F.lit(False))).select(*keys)


def grids(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, grid): rows of cell texts, gaps empty."""
    own = cells.groupBy(*keys, "row").agg(F.max("col").alias("last"), F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("by"))
    row = own.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("by", i.cast("int")), F.lit(""))))
    return row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("grid"))


def array_headers(records: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, key, place): the keys of records (keys, row, pos, key) in the order that they first appear."""
    first = records.groupBy(*keys, "key").agg(F.min(F.struct("row", "pos")).alias("at"))
    by = ", ".join(keys)
    return first.selectExpr(*keys, "key", f"row_number() over (partition by {by} order by at) - 1 as place")


def array_table(records: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cells (keys, row, col, value) of records (keys, row, pos, key, value): row 0 heads, missing keys are empty."""
    k = list(keys)
    heads = array_headers(records, keys)
    frame = records.select(*k, "row").distinct().join(heads, k)
    body = frame.join(records.select(*k, "row", "key", "value"), [*k, "row", "key"], "left")
    body = body.select(*k, (F.col("row") + 1).alias("row"), F.col("place").alias("col"), F.coalesce("value", F.lit("")).alias("value"))
    return heads.select(*k, F.lit(0).alias("row"), F.col("place").alias("col"), F.col("key").alias("value")).unionByName(body)


def continued_tables(page_tables: DataFrame) -> DataFrame:
    """(doc_id, page_a, page_b, ncols): the last table of a page and the first of the next, as wide as each other.

    ``page_tables`` has (doc_id, page, table_no, ncols); a page without a table breaks the chain."""
    own = page_tables.groupBy("doc_id", "page").agg(F.max_by("ncols", "table_no").alias("last"), F.min_by("ncols", "table_no").alias("first"))
    a = own.select("doc_id", F.col("page").alias("page_a"), F.col("last").alias("ncols"))
    b = own.select("doc_id", F.col("page").alias("page_b"), F.col("first").alias("n_b"))
    pairs = a.join(b, (a["doc_id"] == b["doc_id"]) & (F.col("page_b") == F.col("page_a") + 1) & (F.col("ncols") == F.col("n_b")) & (F.col("ncols") > 0))
    return pairs.select(a["doc_id"], "page_a", "page_b", "ncols")


def section_fragments(page_tables: DataFrame) -> DataFrame:
    """Pairs of first tables in sections that follow each other, on pages that do, of about the same width,
    the second without the first one's header. ``page_tables``: (doc_id, section, page, table_no, ncols, header)."""
    first = page_tables.groupBy("doc_id", "section").agg(F.min_by(F.struct("page", "ncols", "header"), "table_no").alias("t"))
    nxt = first.selectExpr("doc_id", "section", "t", "lead(struct(section, t)) over (partition by doc_id order by section) as nxt")
    n = F.col("nxt.t")
    pair = (F.col("nxt.section") == F.col("section") + 1) & (n["page"] == F.col("t.page") + 1) & (F.abs(n["ncols"] - F.col("t.ncols")) <= 1) & ~n["header"].eqNullSafe(F.col("t.header"))
    return nxt.where(pair).select("doc_id", F.col("section").alias("section_a"), F.col("nxt.section").alias("section_b"), F.col("t.page").alias("page_a"), n["page"].alias("page_b"))


def parse_pipe_tables(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn("rows", gfm_rows(F.col(text_col)))


def merge_tables(pairs: DataFrame, answer: Column) -> DataFrame:
    """Pairs with the rows that an answer gives for the joined table; null where the two stay apart."""
    apart = F.upper(F.trim(answer)) == "SEPARATE"
    rows = gfm_rows(answer)
    return pairs.withColumn("merged", F.when(~apart & (F.size(rows) > 0), rows))

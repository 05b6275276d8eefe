"""How much of a document's structure its Markdown kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import percent, strip, word_count
from folioflow.plans.render import runs_text
from folioflow.schema import PASS_MARK

#: With ``$`` and ``.`` ending at line feeds alone.
HEADINGS = r"(?md)^#{1,6} .+"
LISTS = r"(?md)^[\-\*\+] .+|^\d+\. .+"
TABLES = r"(?md)^\|[-| :]+\|$"

#: Weights of headings, tables, lists, token reduction and validity, with and without a token ratio.
WEIGHTS = (0.25, 0.25, 0.15, 0.20, 0.15)
WEIGHTS_WITHOUT = (0.3125, 0.3125, 0.1875, 0.0, 0.1875)
#: The texts of errors and warnings, which users match.
ERRORS = {"ocr_required": "OCR is required but not enabled", "empty_ir": "No content extracted from document", "parse_error": "Document parsing failed"}


def markdown_counts(md: Column) -> dict[str, Column]:
    return {"md_headings": F.regexp_count(md, F.lit(HEADINGS)), "md_lists": F.regexp_count(md, F.lit(LISTS)), "md_tables": F.regexp_count(md, F.lit(TABLES))}


def kept(found: Column, expected: Column) -> Column:
    """Found of expected, one at most; one where nothing was expected."""
    return F.when(expected == 0, F.lit(1.0)).otherwise(F.least(found / F.nullif(expected, F.lit(0)), F.lit(1.0)))


def token_ratio(md_words: Column, source_words: Column) -> Column:
    """How much shorter the Markdown is than a naive reading; null without a word count."""
    ratio = 1.0 - F.least(md_words * 1.3 / F.greatest(source_words * 2.5, F.lit(1.0)), F.lit(1.0))
    return F.when(source_words > 0, F.greatest(ratio, F.lit(0.0)))


def overall(headings: Column, tables: Column, lists: Column, tokens: Column) -> Column:
    a, b = WEIGHTS, WEIGHTS_WITHOUT
    return F.when(tokens.isNotNull(), headings * a[0] + tables * a[1] + lists * a[2] + tokens * a[3] + a[4]).otherwise(headings * b[0] + tables * b[1] + lists * b[2] + b[4])


def node_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, headings, tables, list_items, has_content, has_any_text)."""
    free = F.col("quote").isNull()
    top = F.size(F.coalesce("path", F.array().cast("array<string>"))) <= 1
    said = strip(runs_text(F.coalesce("runs", F.array().cast(nodes.schema["runs"].dataType)))) != ""
    return nodes.groupBy("doc_id").agg(
        F.count_if((F.col("type") == "heading") & (F.size("runs") > 0)).cast("int").alias("headings"),
        F.count_if((F.col("type") == "table") & free).cast("int").alias("tables"),
        F.coalesce(F.sum(F.when((F.col("type") == "list") & free, F.size(F.filter("items", lambda i: i["depth"] == 0)))), F.lit(0)).cast("int").alias("list_items"),
        F.coalesce(F.bool_or(top & free & (((F.col("type") == "paragraph") & said) | (F.col("type") == "table"))), F.lit(False)).alias("has_content"),
        F.coalesce(F.bool_or(said | F.col("type").isin("table", "list", "code")), F.lit(False)).alias("has_any_text"),
    )


def score_columns(md: Column, headings: Column, tables: Column, lists: Column, source_words: Column) -> dict[str, Column]:
    """Unrounded scores from counts and Markdown."""
    found = markdown_counts(md)
    h, t, x = kept(found["md_headings"], headings), kept(found["md_tables"], tables), kept(found["md_lists"], lists)
    tokens = token_ratio(word_count(md), source_words)
    return {"heading_preservation": h, "table_preservation": t, "list_preservation": x, "token_ratio": tokens, "overall_raw": overall(h, t, x, tokens)}


def counts_of(nodes: Column, runs_type) -> dict[str, Column]:
    """As ``node_counts``, of a document's array of nodes."""
    free = lambda n: n["quote"].isNull()
    said = lambda n: strip(runs_text(F.coalesce(n["runs"], F.array().cast(runs_type)))) != ""
    top = lambda n: F.size(F.coalesce(n["path"], F.array().cast("array<string>"))) <= 1
    count = lambda keep: F.size(F.filter(nodes, keep))
    first = lambda n: F.size(F.filter(n["items"], lambda i: i["depth"] == 0))
    lists = F.filter(nodes, lambda n: (n["type"] == "list") & free(n))
    return {
        "headings": count(lambda n: (n["type"] == "heading") & (F.size(n["runs"]) > 0)),
        "tables": count(lambda n: (n["type"] == "table") & free(n)),
        "list_items": F.aggregate(lists, F.lit(0), lambda total, n: total + first(n)),
        "has_content": F.exists(nodes, lambda n: top(n) & free(n) & (((n["type"] == "paragraph") & said(n)) | (n["type"] == "table"))),
        "has_any_text": F.exists(nodes, lambda n: said(n) | n["type"].isin("table", "list", "code")),
    }


def quality(nodes: DataFrame, docs: DataFrame, md: DataFrame) -> DataFrame:
    """The scored quality of each document, null with an error where there is nothing to score."""
    rows = docs.select("doc_id", "outcome", F.col("metadata.word_count").alias("words")).join(md, "doc_id", "left").join(node_counts(nodes), "doc_id", "left")
    return _scored(rows)


def quality_of(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``quality``, of parsed rows with their ``nodes`` and ``markdown``: one projection, nothing moves."""
    runs_type = parsed.schema["nodes"].dataType.elementType["runs"].dataType
    return _scored(parsed.select("doc_id", "outcome", F.col("metadata.word_count").alias("words"), "markdown", *[c.alias(n) for n, c in counts_of(F.col("nodes"), runs_type).items()], *[c for c in keep if c != "markdown"]), keep)


def _scored(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.fillna(0, ["headings", "tables", "list_items"]).fillna("", ["markdown"]).fillna(False, ["has_content", "has_any_text"])
    s = score_columns(F.col("markdown"), F.col("headings"), F.col("tables"), F.col("list_items"), F.col("words"))
    rows = rows.withColumns(s).withColumns(markdown_counts(F.col("markdown")))
    error = F.lit(None).cast("string")
    for outcome, text in ERRORS.items():
        error = F.when(F.col("outcome") == outcome, text).otherwise(error)
    error = F.when(error.isNull() & ~F.col("has_content"), ERRORS["empty_ir"]).otherwise(error)
    good = error.isNull()
    low = lambda name, n: (F.col(n) > 0) & (F.col(name) < 0.8)
    warnings = F.filter(
        F.array(
            F.when(low("heading_preservation", "headings"), F.concat(F.lit("Heading preservation low ("), percent(F.col("heading_preservation")), F.lit("): "), F.col("headings").cast("string"), F.lit(" in source, "), F.col("md_headings").cast("string"), F.lit(" in output"))),
            F.when(low("table_preservation", "tables"), F.concat(F.lit("Table preservation low ("), percent(F.col("table_preservation")), F.lit("): "), F.col("tables").cast("string"), F.lit(" in source"))),
        ),
        lambda w: w.isNotNull(),
    )
    shown = lambda c: F.when(good, F.bround(c, 3))
    return rows.select(
        "doc_id",
        shown("overall_raw").alias("overall"),
        shown("heading_preservation").alias("heading_preservation"),
        shown("table_preservation").alias("table_preservation"),
        shown("list_preservation").alias("list_preservation"),
        shown("token_ratio").alias("token_reduction_ratio"),
        F.when(good, F.lit(True)).otherwise(F.lit(False)).alias("valid_markdown"),
        F.when(good, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
        error.alias("error"),
        (good & (F.bround("overall_raw", 3) >= PASS_MARK)).alias("passed"),
        "has_any_text",
        *keep,
    )

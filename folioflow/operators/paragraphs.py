"""Operators on the text of pages: paragraphs, page numbers, headings by font, rotated runs, damaged encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import is_page_number, lines, strip, word_count

SCANNED_WORDS = 5.0
CORRUPT_SHARE = 0.08
MATH_CHARS, MATH_SHARE = 3, 0.002
HEADING_RATIO, HEADING_CHARS = 1.4, 120


def paragraphs_array(text: Column) -> Column:
    """Stripped lines that aren't blank and don't carry a page number alone."""
    return F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~is_page_number(x))


def paragraphs(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, paragraph)."""
    return pages.select(id_col, F.posexplode(paragraphs_array(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "paragraph"))


def recognised_paragraphs(text: Column) -> Column:
    """Paragraphs of recognised text: lines between blank ones, joined by spaces; bare numbers fall out."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        ends = (x == "") & (s["now"] != "")
        return F.struct(
            F.when(ends, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"),
            F.when(x == "", "").when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x)).alias("now"),
        )

    kept = F.transform(lines(F.coalesce(text, F.lit(""))), strip)
    made = F.aggregate(kept, start, step, lambda s: F.when(s["now"] != "", F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))
    return F.filter(made, lambda p: ~p.rlike(r"^\d+$"))


def corruption(text: Column) -> Column:
    """Share of replacement, control and private-use characters in what isn't white space."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1C-\x1F]", "")
    bad = F.length(F.regexp_replace(shown, r"[^\x{FFFD}\x00-\x1F\x{E000}-\x{F8FF}]", ""))
    return F.when(F.length(shown) == 0, F.lit(0.0)).otherwise(bad / F.length(shown))


def corrupt_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): the pages, in order, whose corruption passes the bound."""
    bad = pages.where(corruption(F.col("text")) > CORRUPT_SHARE)
    return bad.groupBy("doc_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))


#: How the names of mathematical fonts begin, in lower case and without a subset's prefix.
MATH_FONTS = ("cmmi", "cmsy", "msam", "msbm", "mtsy", "rmtmi")


def is_math_char(text: Column, font: Column) -> Column:
    own = F.lower(F.substring_index(F.coalesce(font, F.lit("")), "+", -1))
    named = F.lit(False)
    for p in MATH_FONTS:
        named = named | F.startswith(own, F.lit(p))
    return named | F.coalesce(text, F.lit("")).rlike(r"^[\x{2200}-\x{22FF}\x{1D400}-\x{1D7FF}\x{2100}-\x{214F}]")


def math_pages(chars: DataFrame) -> DataFrame:
    """(doc_id, pages): pages with enough mathematical characters, in number and share."""
    own = chars.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.count_if(is_math_char(F.col("text"), F.col("fontname"))).alias("m"))
    own = own.where((F.col("m") >= MATH_CHARS) & (F.col("m") / F.col("n") >= MATH_SHARE))
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_number")).alias("pages"))


def line_fonts(chars: DataFrame) -> DataFrame:
    """(doc_id, page_number, bucket, size): the largest font of each band of two points."""
    bucket = (F.bround(F.coalesce("top", F.lit(0.0)) / 2, 0) * 2).cast("int").alias("bucket")
    return chars.groupBy("doc_id", "page_number", bucket).agg(F.max(F.coalesce("size", F.lit(0.0))).alias("size")).where("size > 0")


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def promoted_headings(page_lines: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, text, level): lines with the level that their font gives, or null.

    The n-th line takes the n-th band; further lines take the last."""
    own = fonts.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "size"))), lambda b: b["size"]).alias("sizes"))
    rows = page_lines.join(own, ["doc_id", "page_number"], "left")
    size = F.element_at("sizes", F.least(F.col("pos") + 1, F.size("sizes")))
    median = upper_median(F.col("sizes"))
    ratio = F.when(median > 0, size / median).otherwise(1.0)
    heading = (F.size("sizes") > 0) & (size >= median * HEADING_RATIO) & (F.length("text") <= HEADING_CHARS) & ~F.col("text").rlike(r"^\d+$")
    level = F.when(heading, F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).otherwise(3))
    return rows.select("doc_id", "page_number", "pos", "text", level.alias("level"))


def rotated_runs(chars: DataFrame) -> DataFrame:
    """(doc_id, page_number, run, wrong, right): runs of two or more turned characters at about one x."""
    near = 0.01
    m = lambda i: F.get("matrix", F.lit(i))
    turned = chars.where((F.size("matrix") >= 4) & (F.abs(m(0)) < near) & (F.abs(m(3)) < near) & (F.abs(m(1)) > near))
    jump = F.expr("case when abs(x0 - lag(x0) over (partition by doc_id, page_number order by pos)) > 5 then 1 else 0 end")
    runs = turned.withColumn("jump", jump).withColumn("run", F.expr("sum(jump) over (partition by doc_id, page_number order by pos rows unbounded preceding)"))
    own = runs.groupBy("doc_id", "page_number", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda c: c["text"]), "").alias("wrong"), F.count("*").alias("n"))
    return own.where("n >= 2").select("doc_id", "page_number", "run", "wrong", F.reverse("wrong").alias("right"))


def turned_back(text: Column, runs: Column) -> Column:
    """``text`` with the first occurrence of each run's wrong reading replaced; runs are (wrong, right) in order."""
    def step(t: Column, r: Column) -> Column:
        at = F.position(r["wrong"], t)
        return F.when(at > 0, F.concat(F.substring(t, 1, at - 1), r["right"], F.substring(t, at + F.length(r["wrong"]), F.length(t)))).otherwise(t)

    return F.aggregate(runs, text, step)


def body_words(words: DataFrame, tables: DataFrame, top: float = 0.05, bottom: float = 0.90) -> DataFrame:
    """Words of a page's body: between the margins and outside every table's box."""
    inside = words.where((F.col("top") >= F.col("page_h") * top) & (F.col("top") <= F.col("page_h") * bottom))
    w, t = inside.alias("w"), tables.alias("t")
    held = (F.col("w.doc_id") == F.col("t.doc_id")) & (F.col("w.page_number") == F.col("t.page_number")) & F.col("w.x0").between(F.col("t.x0"), F.col("t.x1")) & F.col("w.top").between(F.col("t.top"), F.col("t.bottom"))
    return w.join(t, held, "left_anti")


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page_number, table_no, row, col, value): each cell's words in reading order, joined by spaces; no box, no words."""
    w, c = words.alias("w"), cells.alias("c")
    inside = (F.col("w.doc_id") == F.col("c.doc_id")) & (F.col("w.page_number") == F.col("c.page_number")) & (F.col("w.x0") >= F.col("c.x0")) & (F.col("w.x0") < F.col("c.x1")) & (F.col("w.top") >= F.col("c.top")) & (F.col("w.top") < F.col("c.bottom"))
    key = [F.col(f"c.{k}").alias(k) for k in ("doc_id", "page_number", "table_no", "row", "col")]
    got = c.join(w, inside, "left").select(*key, F.col("w.top").alias("t"), F.col("w.x0").alias("x"), F.col("w.text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("t", "x", "text"))))
    return got.groupBy("doc_id", "page_number", "table_no", "row", "col").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("value"))


def scanned(words_total: Column, pages_total: Column) -> Column:
    """Fewer than five words a page; never without pages."""
    return F.coalesce(pages_total > 0, F.lit(False)) & (words_total / F.greatest(pages_total, F.lit(1)) < SCANNED_WORDS)


def scanned_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, words, pages, scanned) of page texts."""
    own = pages.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("words"), F.count("*").alias("pages"))
    return own.withColumn("scanned", scanned(F.col("words"), F.col("pages")))


def labelled_blocks(items: DataFrame) -> DataFrame:
    """Recognised layout items (doc_id, pos, label, text) as nodes' kinds: title and section headers open sections,
    following list items share an island, other labels fall out."""
    kind = F.expr("case label when 'title' then 'heading' when 'section_header' then 'heading' when 'text' then 'paragraph' when 'paragraph' then 'paragraph' when 'list_item' then 'list' when 'code' then 'code' when 'formula' then 'code' when 'table' then 'table' end")
    rows = items.withColumn("kind", kind).where("kind is not null").withColumn("level", F.expr("case label when 'title' then 1 when 'section_header' then 2 end"))
    fresh = F.expr("case when kind = 'list' and lag(kind) over (partition by doc_id order by pos) = 'list' then 0 else 1 end")
    return rows.withColumn("fresh", fresh).withColumn("block", F.expr("sum(fresh) over (partition by doc_id order by pos rows unbounded preceding)")).drop("fresh")

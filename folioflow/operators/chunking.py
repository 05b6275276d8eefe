"""Retrieval chunks: sections cut at tables and packed greedily under a token bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import strip, token_estimate
from folioflow.plans.render import node_markdown, run_markdown, runs_with
from folioflow.schema import CHUNK_TOKENS

_TEXTS = "array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever lambda this stands in."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack_texts(parts: Column, prefix: Column, bound: int = CHUNK_TOKENS) -> Column:
    """Texts joined by blank lines into bins of at most ``bound`` estimated tokens; the first bin opens with ``prefix``.

    A bin closes when the next text would pass the bound; a text above the bound has a bin of its own.
    What stands between texts isn't counted. A fold finds where bins start, and each is then cut out whole."""
    whole = F.concat(prefix, F.array_join(parts, "\n\n"))
    start = F.struct(F.array(F.lit(0)).alias("starts"), token_estimate(prefix).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("first"))

    def step(s: Column, n: Column) -> Column:
        full = (s["i"] > s["first"]) & (s["n"] + n > bound)
        return F.struct(
            F.when(full, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
            F.when(full, n).otherwise(s["n"] + n).alias("n"),
            (s["i"] + 1).alias("i"),
            F.when(full, s["i"]).otherwise(s["first"]).alias("first"),
        )

    def cut(starts: Column) -> Column:
        own = lambda s, k: F.array_join(F.slice(parts, s + 1, F.coalesce(F.get(starts, k + 1), F.size(parts)) - s), "\n\n")
        return F.transform(starts, lambda s, k: F.concat(F.when(k == 0, prefix).otherwise(""), own(s, k)))

    bins = _let(F.aggregate(F.transform(parts, token_estimate), start, step, lambda s: s["starts"]), cut)
    return _let(whole, lambda w: F.when(token_estimate(w) <= bound, F.array(w)).otherwise(bins))


def _blocks(parts: Column) -> Column:
    """Parts of a section with those of one quote made one, marked line by line."""
    start = F.array().cast("array<struct<quote:int,table:boolean,text:string>>")

    def step(s: Column, p: Column) -> Column:
        text = F.when(p["quote"].isNull(), p["text"]).otherwise(F.concat(F.lit("> "), F.replace(p["text"], F.lit("\n"), F.lit("\n> "))))
        last = F.try_element_at(s, F.lit(-1))
        same = F.coalesce(last["quote"] == p["quote"], F.lit(False))
        joined = F.concat(last["text"], F.lit("\n> \n"), text)
        one = lambda t: F.array(F.struct(p["quote"].alias("quote"), p["table"].alias("table"), t.alias("text")))
        return F.when(same, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), one(joined))).otherwise(F.concat(s, one(text)))

    return F.aggregate(parts, start, step)


def _islands(blocks: Column) -> Column:
    """Tables alone, and the blocks between them together."""
    start = F.array().cast("array<struct<table:boolean,texts:array<string>>>")

    def step(s: Column, b: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        joins = F.coalesce(~last["table"], F.lit(False)) & ~b["table"]
        one = lambda t: F.array(F.struct(b["table"].alias("table"), t.alias("texts")))
        return F.when(joins, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), one(F.concat(last["texts"], F.array(b["text"]))))).otherwise(F.concat(s, one(F.array(b["text"]))))

    return F.aggregate(blocks, start, step)


def section_chunks(level: Column, heading: Column, parts: Column, bound: int = CHUNK_TOKENS) -> Column:
    """The chunks of a section, an array of (type, content, token_count); ``parts`` is an ordered array of (quote, table, text)."""
    one = lambda kind, text, n: F.struct(F.lit(kind).alias("type"), text.alias("content"), n.alias("token_count"))
    none = F.array().cast("array<struct<type:string,content:string,token_count:int>>")
    shown = F.filter(_blocks(parts), lambda b: b["table"] | (strip(b["text"]) != ""))
    prefix = F.when(heading != "", F.concat(F.repeat(F.lit("#"), F.greatest(F.coalesce(level, F.lit(1)), F.lit(1))), F.lit(" "), heading, F.lit("\n\n"))).otherwise("")

    def made(front: Column, islands: Column) -> Column:
        texts = lambda x, i: _let(pack_texts(x["texts"], F.when(i == 0, front).otherwise(""), bound), lambda cut: F.transform(cut, lambda t: one("section", t, token_estimate(t))))
        every = F.flatten(F.transform(islands, lambda x, i: F.when(x["table"], F.array(one("table", x["texts"][0], token_estimate(x["texts"][0])))).otherwise(texts(x, i))))
        return F.when(F.size(islands) > 0, every).when(front != "", F.array(one("section", strip(front), token_estimate(front)))).otherwise(none)

    return _let(prefix, lambda front: _let(_islands(shown), lambda islands: made(front, islands)))


def chunk_sections(sections: DataFrame, bound: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of rows (doc_id, section, level, heading, heading_path, parts): adds ``chunks``, as ``section_chunks`` gives them."""
    return sections.withColumn("chunks", section_chunks(F.col("level"), F.col("heading"), F.col("parts"), bound))


def number_chunks(rows: DataFrame, source: str = "doc_id", fmt: str | None = None) -> DataFrame:
    """A row per chunk, numbered through the document, with an id made of the source's hash.

    One grouping on the document; ``rows`` has (doc_id, section, heading_path, chunks) and ``source``."""
    first = [F.first(c).alias(c) for c in {source, *( [fmt] if fmt else [])} - {"doc_id"}]
    tagged = F.transform("chunks", lambda c: F.struct(F.col("heading_path").alias("heading_path"), c.alias("c")))
    own = rows.withColumn("tagged", tagged).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "tagged"))), lambda s: s["tagged"])).alias("all"), *first)
    flat = own.select("*", F.posexplode("all").alias("n", "x"))
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    return flat.select(
        "doc_id",
        F.format_string("%s_%04d", F.substring(F.md5(name), 1, 8), F.col("n")).alias("chunk_id"),
        F.col("x.c.type").alias("type"),
        F.col("x.heading_path").alias("heading_path"),
        F.col("x.c.content").alias("content"),
        name.alias("source_document"),
        (F.col(fmt) if fmt else F.lit("")).alias("source_format"),
        F.col("x.c.token_count").alias("token_count"),
    )


def sections_of(nodes: DataFrame) -> DataFrame:
    """The rows that ``chunk_sections`` takes, of a node table."""
    heading = F.col("type") == "heading"
    text = runs_with(F.col("runs"), run_markdown)
    part = F.struct("node_id", "quote", (F.col("type") == "table").alias("table"), node_markdown().alias("text"))
    path = F.regexp_replace(F.array_join(F.filter("path", lambda p: p != ""), " > "), "^[ >]+", "")
    return nodes.groupBy("doc_id", "section").agg(
        F.max(F.when(heading, F.col("level"))).alias("level"),
        F.coalesce(F.max(F.when(heading, text)), F.lit("")).alias("heading"),
        F.max(path).alias("heading_path"),
        F.array_sort(F.collect_list(F.when(~heading, part))).alias("parts"),
    )


def chunks(nodes: DataFrame, docs: DataFrame | None = None, bound: int = CHUNK_TOKENS) -> DataFrame:
    """Retrieval chunks of a node table; ``docs`` gives source names and formats."""
    rows = chunk_sections(sections_of(nodes), bound)
    if docs is None:
        return number_chunks(rows)
    return number_chunks(rows.join(docs.select("doc_id", "source", F.col("metadata.source_format").alias("fmt")), "doc_id"), "source", "fmt")


def chunk_array(nodes: Column, source: Column, fmt: Column, bound: int = CHUNK_TOKENS) -> Column:
    """The numbered chunks of a document's array of nodes, within its row."""
    path = lambda n: F.regexp_replace(F.array_join(F.filter(n["path"], lambda p: p != ""), " > "), "^[ >]+", "")
    part = lambda n: F.struct(n["quote"].alias("quote"), (n["type"] == "table").alias("table"), node_markdown(n.getField).alias("text"))

    def of_section(own: Column) -> Column:
        heads = F.filter(own, lambda n: n["type"] == "heading")
        heading = F.coalesce(F.array_max(F.transform(heads, lambda n: runs_with(n["runs"], run_markdown))), F.lit(""))
        parts = F.transform(F.filter(own, lambda n: n["type"] != "heading"), part)
        found = _let(heading, lambda h: section_chunks(F.array_max(F.transform(heads, lambda n: n["level"])), h, parts, bound))
        return _let(F.array_max(F.transform(own, path)), lambda p: F.transform(found, lambda c: F.struct(p.alias("heading_path"), c.alias("c"))))

    opens = F.filter(F.transform(nodes, lambda n, i: F.when((i == 0) | (n["section"] != F.get(nodes, i - 1)["section"]), i)), lambda i: i.isNotNull())
    every = _let(opens, lambda starts: F.flatten(F.transform(starts, lambda s, k: of_section(F.slice(nodes, s + 1, F.coalesce(F.get(starts, k + 1), F.size(nodes)) - s)))))
    name = F.coalesce(source.cast("string"), F.lit(""))
    return F.transform(
        every,
        lambda x, n: F.struct(
            F.format_string("%s_%04d", F.substring(F.md5(name), 1, 8), n).alias("chunk_id"),
            x["c"]["type"].alias("type"),
            x["heading_path"].alias("heading_path"),
            x["c"]["content"].alias("content"),
            name.alias("source_document"),
            fmt.alias("source_format"),
            x["c"]["token_count"].alias("token_count"),
        ),
    )


def chunks_of(parsed: DataFrame, bound: int = CHUNK_TOKENS) -> DataFrame:
    """As ``chunks``, of parsed rows with their array of nodes; nothing moves."""
    return parsed.select("doc_id", F.explode(chunk_array(F.col("nodes"), F.col("source"), F.col("metadata.source_format"), bound)).alias("c")).select("doc_id", "c.*")


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bound: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of plain texts, a paragraph a line; nothing is shuffled, since a text is a row."""
    from folioflow.operators.paragraphs import paragraphs_array

    parts = paragraphs_array(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), parts.alias("parts")).where(F.size("parts") > 0)
    flat = rows.select("doc_id", "source", F.posexplode(pack_texts(F.col("parts"), F.lit(""), bound)).alias("n", "content"))
    name = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return flat.select("doc_id", F.format_string("%s_%04d", F.substring(F.md5(name), 1, 8), "n").alias("chunk_id"), F.lit("section").alias("type"), "content", name.alias("source_document"), token_estimate(F.col("content")).alias("token_count"))

"""The life of a conversion: scan, parse, enrich, render, score, assemble."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.chunking import chunk_array, chunks
from folioflow.operators.quality import quality, quality_of
from folioflow.plans import render
from folioflow.schema import MAX_FILE_BYTES, MAX_TABLE_ROWS
from folioflow.sources.external import caption_images, extract_fields, refuse
from folioflow.sources.registry import Registry, documents_of, nodes_of, parse_sources, registry, scan

AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".mp4")


@dataclass(frozen=True)
class Options:
    """What a conversion can be told."""

    output: str = "markdown"
    images: str = "extract"
    max_table_rows: int = MAX_TABLE_ROWS
    max_file_size: int = MAX_FILE_BYTES
    include_metadata: bool = False
    extract_content: bool = False
    extract_schema: str | None = None
    language_model: Callable[[str], str] = refuse
    vision_model: Callable[[str], str] = refuse
    extra: dict = field(default_factory=dict)

    def for_parsers(self) -> dict:
        return {"images": self.images, "max_table_rows": self.max_table_rows, "extract_content": self.extract_content} | self.extra


def to_parsed(sources: DataFrame, options: Options = Options(), formats: Registry = registry) -> DataFrame:
    """Sources (doc_id, source, ext, content) parsed, a row per document. Recordings need their transcript first."""
    bad = F.col("ext").isin(*AUDIO)
    held = sources.withColumn("refused", F.when(bad, F.lit("recordings are converted as transcripts")).otherwise(F.col("refused") if "refused" in sources.columns else F.lit(None))).withColumn("content", F.when(~bad, F.col("content")))
    parsed = parse_sources(held, formats, options.for_parsers())
    return parsed.withColumn("nodes", F.filter("nodes", lambda n: n["type"] != "image")) if options.images == "suppress" else parsed


def to_nodes(sources: DataFrame, options: Options = Options(), formats: Registry = registry) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes) of sources, for transforms of one's own."""
    parsed = to_parsed(sources, options, formats)
    nodes = nodes_of(parsed)
    if options.images == "caption":
        nodes, _ = caption_images(nodes, options.vision_model)
    return documents_of(parsed), nodes


def _body(rows: DataFrame, options: Options) -> DataFrame:
    """Rows with their ``markdown``, finished as the options say."""
    if options.include_metadata:
        front = render.front_matter(F.col("metadata"))
        rows = rows.withColumn("markdown", F.concat_ws("\n\n", F.nullif(front, F.lit("")), F.nullif("markdown", F.lit(""))))
    return extract_fields(rows, options.extract_schema, options.language_model) if options.extract_schema else rows


def _check(options: Options) -> None:
    if options.output not in ("markdown", "html", "json", "chunks"):
        raise ValueError(f"unknown output {options.output!r}")


def parsed_results(parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """As ``results``, of documents whose nodes are as parsed: each renders and is scored in its own row."""
    _check(options)
    kept = [c for c in parsed.columns if c != "nodes"]
    rows = parsed.withColumn("markdown", render.markdown_of(F.col("nodes"))).withColumn("own", F.struct(*kept, "nodes"))
    scored = quality_of(rows, ("markdown", "own"))
    figures = [c for c in scored.columns if c not in ("doc_id", "markdown", "own")]
    body = _body(scored.select(*[F.col(f"own.{c}") for c in kept], "markdown", F.struct(*figures).alias("quality"), F.col("own.nodes").alias("nodes")), options)
    made = {
        "html": lambda n: render.html_of(n),
        "json": lambda n: render.json_of(n, F.col("metadata")),
        "chunks": lambda n: chunk_array(n, F.col("source"), F.col("metadata.source_format")),
    }
    if options.output in made:
        body = body.withColumn(options.output, made[options.output](F.col("nodes")))
    return body.drop("nodes")


def results(docs: DataFrame, nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per document: markdown, quality and the output asked for, of documents and a table of their nodes."""
    _check(options)
    md = render.markdown(nodes)
    body = docs.join(md, "doc_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))
    scored = quality(nodes, docs, md)
    scored = scored.select("doc_id", F.struct(*[c for c in scored.columns if c != "doc_id"]).alias("quality"))
    body = _body(body.join(scored, "doc_id", "left"), options)
    if options.output == "html":
        return body.join(render.html_document(nodes), "doc_id", "left")
    if options.output == "json":
        return body.join(render.json_document(nodes, docs), "doc_id", "left")
    if options.output == "chunks":
        own = chunks(nodes, docs)
        listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in own.columns if c != "doc_id"]))).alias("chunks"))
        return body.join(listed, "doc_id", "left")
    return body


def convert_sources(sources: DataFrame, options: Options = Options(), formats: Registry = registry) -> DataFrame:
    """Sources to results; only captions, which are asked for image by image, need the nodes as a table."""
    if options.images == "caption":
        return results(*to_nodes(sources, options, formats), options)
    return parsed_results(to_parsed(sources, options, formats), options)


def convert(spark: SparkSession, paths: str | list[str], options: Options = Options(), formats: Registry = registry) -> DataFrame:
    """Files to results."""
    return convert_sources(scan(spark, paths, options.max_file_size), options, formats)


def convert_to_nodes(spark: SparkSession, paths: str | list[str], options: Options = Options(), formats: Registry = registry) -> tuple[DataFrame, DataFrame]:
    """Files to (documents, nodes), for transforms of one's own before ``results``."""
    return to_nodes(scan(spark, paths, options.max_file_size), options, formats)


def convert_stream(spark: SparkSession, paths: str | list[str], options: Options = Options(), formats: Registry = registry) -> Iterator[tuple[str, str]]:
    """(doc_id, text) per top-level section in reading order, a partition at a time."""
    docs, nodes = convert_to_nodes(spark, paths, options, formats)
    rows = render.section_markdown(nodes).select("doc_id", "section", "markdown")
    if options.include_metadata:
        front = docs.select("doc_id", F.lit(-1).alias("section"), render.front_matter(F.col("metadata")).alias("markdown")).where("markdown <> ''")
        rows = rows.unionByName(front)
    for r in rows.orderBy("doc_id", "section").toLocalIterator():
        yield r["doc_id"], r["markdown"]


def write_images(nodes: DataFrame, path: str) -> None:
    """The images of nodes as a table of their own, a row per image."""
    nodes.where("type = 'image'").select("doc_id", "node_id", "image.*").write.mode("overwrite").parquet(path)

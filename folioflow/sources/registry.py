"""Formats, how files find their parser, and the scan that runs it."""

from __future__ import annotations

import importlib
import importlib.util
import json
import mimetypes
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.schema import MAX_FILE_BYTES, METADATA, NODE_FIELDS, WARNING
from folioflow.sources.nodes import Outline

Parser = Callable[[bytes, dict], Outline]


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    parser: str | Parser  # "module:function", or the function
    mime: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()

    def load(self) -> Parser:
        if callable(self.parser):
            return self.parser
        module, _, name = self.parser.partition(":")
        return getattr(importlib.import_module(module), name)

    def missing(self) -> list[str]:
        return [m for m in self.requires if importlib.util.find_spec(m) is None]


@dataclass
class Registry:
    """Formats by extension. Formats whose needs are missing are known, but not available."""

    formats: dict[str, Format] = field(default_factory=dict)

    def register(self, fmt: Format) -> Format:
        self.formats[fmt.name] = fmt
        return fmt

    def find(self, path: str) -> Format:
        """The format of a path, by its extension and then by its guessed type."""
        ext = os.path.splitext(path)[1].lower()
        for f in self.formats.values():
            if ext in f.extensions:
                if f.missing():
                    raise LookupError(f"{f.name} needs {', '.join(f.missing())}")
                return f
        guess = mimetypes.guess_type(path)[0]
        for f in self.formats.values():
            if guess and guess in f.mime:
                return f
        raise LookupError(f"no parser for {ext or path!r}; known: {', '.join(self.extensions())}")

    def extensions(self) -> list[str]:
        return sorted(e for f in self.formats.values() if not f.missing() for e in f.extensions)

    def skipped(self) -> dict[str, list[str]]:
        return {f.name: m for f in self.formats.values() if (m := f.missing())}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ext, format, available, missing)."""
        rows = [(e, f.name, not f.missing(), f.missing()) for f in self.formats.values() for e in f.extensions]
        return spark.createDataFrame(rows, "ext string, format string, available boolean, missing array<string>")


registry = Registry()
_S = "folioflow.sources"
for _f in (
    Format("html", (".html", ".htm"), f"{_S}.html:parse", ("text/html",)),
    Format("json", (".json",), f"{_S}.json_source:parse", ("application/json",)),
    Format("sql", (".sql",), f"{_S}.sqlddl:parse", ("application/sql",)),
    Format("wsdl", (".wsdl", ".wsd"), f"{_S}.wsdl:parse"),
    Format("csv", (".csv",), f"{_S}.sheets:parse_csv", ("text/csv",)),
    Format("xlsx", (".xlsx", ".xlsm"), f"{_S}.sheets:parse_xlsx", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    Format("docx", (".docx",), f"{_S}.office:parse_docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    Format("pptx", (".pptx",), f"{_S}.office:parse_pptx", ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    Format("pdf", (".pdf",), f"{_S}.pdf:parse", ("application/pdf",)),
    Format("epub", (".epub",), f"{_S}.epub:parse", ("application/epub+zip",)),
):
    registry.register(_f)

PARSED = f"outcome string, metadata {METADATA}, warnings array<{WARNING}>, notes array<string>, nodes array<struct<{NODE_FIELDS}>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def scan(spark: SparkSession, paths: str | list[str], most: int = MAX_FILE_BYTES) -> DataFrame:
    """(doc_id, source, ext, length, content, refused) of files. Files above ``most`` bytes keep their row, not their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    big = F.col("length") > most
    refused = F.when(big, F.concat(F.lit("larger than "), F.lit(most).cast("string"), F.lit(" bytes")))
    return files.select(F.md5("path").alias("doc_id"), F.col("path").alias("source"), extension(F.col("path")).alias("ext"), "length", F.when(~big, F.col("content")).alias("content"), refused.alias("refused"))


def parse_one(fmt_of: Callable[[str], Format], ext: str, content: bytes | None, refused: str | None, options: dict) -> dict:
    """The row of one file; whatever goes wrong becomes its outcome and a note."""
    out = Outline(ext.lstrip("."))
    if content is None:
        out.outcome = "parse_error"
        out.notes.append(refused or "no content")
        return out.row()
    try:
        return fmt_of("x" + ext).load()(bytes(content), options | {"extension": ext}).row()
    except Exception as e:  # noqa: BLE001  one bad file must not end the scan of all
        out = Outline(ext.lstrip("."))
        out.outcome = "parse_error"
        out.notes.append(f"{type(e).__name__}: {e}")
        return out.row()


def parse_sources(sources: DataFrame, formats: Registry = registry, options: dict | None = None) -> DataFrame:
    """``sources`` (doc_id, source, ext, content[, refused]) parsed: a row per document, its nodes an array."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL("doc_id string, source string, " + PARSED)
    arrow, own = to_arrow_schema(schema), options or {}
    refused = F.col("refused") if "refused" in sources.columns else F.lit(None).cast("string").alias("refused")
    rows = sources.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), "ext", F.col("content").cast("binary").alias("content"), refused)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # a parsed document can be many times its source
                made = [
                    {"doc_id": r["doc_id"], "source": r["source"]} | parse_one(formats.find, r["ext"] or "", r["content"], r["refused"], own)
                    for r in batch.slice(lo, 64).to_pylist()
                ]
                yield from pa.Table.from_pylist(made, schema=arrow).to_batches()

    return rows.mapInArrow(run, schema)


def documents_of(parsed: DataFrame) -> DataFrame:
    return parsed.drop("nodes")


def nodes_of(parsed: DataFrame) -> DataFrame:
    """A row per node, in the flat model."""
    return parsed.select("doc_id", F.inline("nodes"))


def options_json(options: dict) -> str:
    """Options as they travel to a worker; what can't travel stays behind."""
    return json.dumps({k: v for k, v in options.items() if isinstance(v, (str, int, float, bool, list, dict, type(None)))}, sort_keys=True)


def options_from(text: str) -> dict:
    return json.loads(text)


def _register_legacy() -> None:
    from folioflow.sources import office, sheets
    from folioflow.sources.external import legacy_parser

    registry.register(Format("doc", (".doc",), legacy_parser("docx", office.parse_docx)))
    registry.register(Format("odt", (".odt",), legacy_parser("docx", office.parse_docx, "Converted from ODT; some formatting may differ.")))
    registry.register(Format("xls", (".xls",), legacy_parser("xlsx", sheets.parse_xlsx)))
    registry.register(Format("ppt", (".ppt",), legacy_parser("pptx", office.parse_pptx)))


_register_legacy()

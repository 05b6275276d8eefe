"""Interfaces to what lies outside: language and vision models, recognition, transcription, downloads, converters.

Nothing here reaches a network by itself. A caller hands in a function; without one, a call says so.
Answers come as (value, error): an error is a column, not a failed job.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "value string, error string"
CONVERT_SECONDS = 60


class NotProvided(RuntimeError):
    pass


def refuse(*_args) -> str:
    raise NotProvided("no service was provided")


@dataclass(frozen=True)
class Retrying:
    """Calls again after a pause; the message of a lasting failure has no secret in it."""

    call: Callable[[str], str]
    attempts: int = 3
    pause: float = 1.0
    secret: str = ""

    def __call__(self, text: str) -> tuple[str | None, str | None]:
        error = None
        for i in range(self.attempts):
            try:
                return self.call(text), None
            except NotProvided as e:
                return None, str(e)
            except Exception as e:  # noqa: BLE001
                error = str(e).replace(self.secret, "***") if self.secret else str(e)
                if i + 1 < self.attempts:
                    time.sleep(self.pause)
        return None, error


def ask(prompt: Column, service: Callable[[str], str] = refuse, **retry) -> Column:
    """(value, error) of a service for each prompt; null prompts aren't asked."""
    client = Retrying(service, **retry)

    @F.pandas_udf(ANSWER)
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in parts:
            yield pd.DataFrame([(None, None) if p is None else client(p) for p in prompts], columns=["value", "error"])

    return answer(prompt)


def extract_fields(docs: DataFrame, schema_text: str, service: Callable[[str], str] = refuse, text_col: str = "markdown") -> DataFrame:
    """``extracted`` and ``extract_error``: a JSON object that a service reads out of a text, asked once more if its answer isn't one."""
    from folioflow.functions.text import strip_fence

    want = F.lit(f"Give a JSON object of this schema, and nothing else.\n{schema_text}\n\n")
    is_object = lambda c: F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    once = docs.withColumn("a1", ask(F.concat(want, F.col(text_col)), service)).withColumn("o1", strip_fence(F.col("a1.value")))
    good = F.coalesce(is_object(F.col("o1")), F.lit(False))
    again = F.when(~good & F.col("a1.error").isNull(), F.concat(F.lit("That was no JSON object. "), want, F.col(text_col)))
    twice = once.withColumn("a2", ask(again, service)).withColumn("o2", strip_fence(F.col("a2.value")))
    better = F.coalesce(is_object(F.col("o2")), F.lit(False))
    value = F.when(good, F.col("o1")).when(better, F.col("o2"))
    error = F.when(value.isNull(), F.coalesce("a1.error", "a2.error", F.lit("no JSON object in the answer")))
    return twice.withColumn("extracted", value).withColumn("extract_error", error).drop("a1", "a2", "o1", "o2")


def topic_ranges(answer: Column) -> Column:
    """An answer's ranges as structs, or null unless it lists objects with whole numbers and a topic."""
    ranges = F.from_json(answer, "array<struct<start_index:int,end_index:int,topic:string>>")
    whole = F.forall(ranges, lambda r: r["start_index"].isNotNull() & r["end_index"].isNotNull() & r["topic"].isNotNull())
    return F.when((F.size(ranges) > 0) & whole, ranges)


def caption_images(nodes: DataFrame, service: Callable[[str], str] = refuse) -> tuple[DataFrame, DataFrame]:
    """Nodes with captions, and (doc_id, node_id, type, message) of images that got none."""
    from folioflow.operators.images import to_caption

    asked = to_caption(nodes).select("doc_id", "node_id", ask(F.col("image.path"), service).alias("a"))
    named = nodes.join(asked, ["doc_id", "node_id"], "left").withColumn("image", F.when(F.col("a.value").isNotNull(), F.col("image").withField("caption", F.col("a.value"))).otherwise(F.col("image"))).drop("a")
    failed = asked.where("a.error is not null").select("doc_id", "node_id", F.lit("caption_failed").alias("type"), F.col("a.error").alias("message"))
    return named, failed


def recognise(pages: DataFrame, engines: dict[str, Callable[[str], str]], forced: str | None = None) -> DataFrame:
    """Text of page images by the first engine that gives some, or by the forced one alone."""
    if forced and forced not in engines:
        raise LookupError(f"unknown engine {forced!r}")
    out = pages.withColumn("text", F.lit(None).cast("string")).withColumn("engine", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    for name in [forced] if forced else list(engines):
        out = out.withColumn("a", ask(F.when(F.col("text").isNull(), F.col("image_path")), engines[name]))
        out = out.withColumn("engine", F.when(F.col("text").isNull() & F.col("a.value").isNotNull(), F.lit(name)).otherwise(F.col("engine"))).withColumn("error", F.coalesce("a.error", "error")).withColumn("text", F.coalesce("text", "a.value")).drop("a")
    return out


def transcribe(recordings: DataFrame, engine: str, engines: dict[str, Callable[[str], list[tuple]]]) -> DataFrame:
    """(doc_id, seg_no, text, start, end, speaker): an engine's segments; a failing recording has none."""
    if engine not in engines:
        raise ValueError(f"unknown engine {engine!r}")
    call = engines[engine]

    def run(parts):
        for part in parts:
            rows = []
            for doc, path in zip(part["doc_id"], part["path"], strict=True):
                try:
                    rows += [(doc, i, t, float(s), float(e), None) for i, (t, s, e) in enumerate(call(path))]
                except Exception:  # noqa: BLE001  a recording that can't be read has no segments
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "text", "start", "end", "speaker"])

    return recordings.select("doc_id", "path").mapInPandas(run, "doc_id string, seg_no int, text string, start double, end double, speaker string")


#: Where an office suite may be, after what the environment names.
OFFICE_PATHS = ("soffice", "libreoffice", "/usr/bin/soffice", "/usr/bin/libreoffice", "/usr/local/bin/soffice", "/opt/libreoffice/program/soffice", "/snap/bin/libreoffice", "/Applications/LibreOffice.app/Contents/MacOS/soffice")


def find_office(variable: str = "OFFICE_COMMAND") -> str | None:
    named = os.environ.get(variable)
    for path in ((named,) if named else ()) + OFFICE_PATHS:
        if found := shutil.which(path):
            return found
    return None


def convert_legacy(content: bytes, extension: str, to: str) -> bytes:
    """A file converted by an office suite on this executor, or NotProvided."""
    office = find_office()
    if office is None:
        raise NotProvided("no office suite was found")
    with tempfile.TemporaryDirectory() as folder:  # scratch of one call; nothing else reads it
        source = os.path.join(folder, "in" + extension)
        with open(source, "wb") as f:
            f.write(content)
        subprocess.run([office, "--headless", "--convert-to", to, "--outdir", folder, source], check=True, timeout=CONVERT_SECONDS, capture_output=True)
        with open(os.path.join(folder, "in." + to), "rb") as f:
            return f.read()


def legacy_parser(to: str, parse: Callable, note: str | None = None, convert: Callable[[bytes, str, str], bytes] = convert_legacy) -> Callable:
    """A parser for an old format: convert, then parse."""

    def run(content: bytes, options: dict):
        out = parse(convert(content, options.get("extension", ""), to), options | {"extension": "." + to})
        if note:
            out.notes.append(note)
        return out

    return run


def fetch(sources: DataFrame, download: Callable[[str], bytes] = refuse) -> DataFrame:
    """Shared documents (doc_id, source) with content by file id, or why there is none."""
    from folioflow.functions.text import drive_file_id

    @F.pandas_udf("content binary, error string")
    def get(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in parts:
            rows = []
            for i in ids:
                try:
                    rows.append((download(i), None) if i is not None else (None, "no file id"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, "permission denied" if "403" in str(e) else "not found" if "404" in str(e) else str(e)))
            yield pd.DataFrame(rows, columns=["content", "error"])

    return sources.withColumn("file_id", drive_file_id(F.col("source"))).withColumn("got", get(F.col("file_id"))).select(*sources.columns, "file_id", "got.content", "got.error")


#: Extensions of shortcuts to shared documents, the words of their addresses, and what they are exported as.
SHARED = {".gdoc": ("/document/", ".docx"), ".gsheet": ("/spreadsheets/", ".xlsx"), ".gslides": ("/presentation/", ".pptx")}


def shared_sources(sources: DataFrame, download: Callable[[str], bytes] = refuse) -> DataFrame:
    """``sources`` (doc_id, source, ext, content) in which shortcut files and addresses of shared documents are
    replaced by what they stand for, so that the parsers can take them; what can't be fetched says why in ``refused``."""
    from folioflow.functions.text import drive_file_id

    note = F.decode(F.col("content"), "utf-8")
    address = F.when(F.col("ext").isin(*SHARED), F.coalesce(F.get_json_object(note, "$.doc_id"), F.get_json_object(note, "$.url"), F.lit(""))).otherwise(F.col("source"))
    kind = F.lit(None).cast("string")
    for ext, (word, export) in SHARED.items():
        kind = F.when((F.col("ext") == ext) | (F.col("ext").isin("") | F.col("ext").isNull()) & F.contains(F.col("source"), F.lit(word)), export).otherwise(kind)
    known = sources.withColumn("export", kind)
    plain = known.where("export is null").select("doc_id", "source", "ext", "content", F.lit(None).cast("string").alias("refused"))
    wanted = known.where("export is not null").select("doc_id", F.col("source").alias("named"), F.col("export").alias("ext"), drive_file_id(address).alias("source"))
    got = fetch(wanted, download).select("doc_id", F.col("named").alias("source"), "ext", "content", F.col("error").alias("refused"))
    return plain.unionByName(got)


def post_until_taken(post: Callable[[str, str], int], url: str, body: str, attempts: int = 3, pauses: tuple[float, ...] = (1, 2, 4)) -> tuple[int, str | None]:
    """How many attempts a callback took, and the error of the last one or None: an answer of the 200s takes it."""
    error = None
    for n in range(1, attempts + 1):
        try:
            status = post(url, body)
            error = None if 200 <= status < 300 else f"status {status}"
        except Exception as e:  # noqa: BLE001
            error = str(e)
        if error is None:
            return n, None
        if n < attempts:
            time.sleep(pauses[min(n - 1, len(pauses) - 1)])
    return attempts, error


def deliver(results: DataFrame, post: Callable[[str, str], int], attempts: int = 3, pauses: tuple[float, ...] = (1, 2, 4)) -> DataFrame:
    """(job_id, delivered, attempts, error): results (job_id, url, body) posted until an answer of the 200s comes."""

    def run(parts):
        for part in parts:
            tried = [(job, *post_until_taken(post, url, body, attempts, pauses)) for job, url, body in zip(part["job_id"], part["url"], part["body"], strict=True)]
            yield pd.DataFrame([(job, error is None, n, error) for job, n, error in tried], columns=["job_id", "delivered", "attempts", "error"])

    return results.select("job_id", "url", "body").mapInPandas(run, "job_id string, delivered boolean, attempts int, error string")


def write_files(files: DataFrame, put: Callable[[str, bytes], None]) -> DataFrame:
    """(name, error) of files (name, content) handed to ``put`` on the executors; a failing file is a row with its error."""

    def run(parts):
        for part in parts:
            rows = []
            for name, content in zip(part["name"], part["content"], strict=True):
                try:
                    put(name, bytes(content))
                    rows.append((name, None))
                except OSError as e:
                    rows.append((name, str(e)))
            yield pd.DataFrame(rows, columns=["name", "error"])

    return files.select("name", "content").mapInPandas(run, "name string, error string")

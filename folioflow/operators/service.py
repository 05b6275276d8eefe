"""Jobs, requests and events of a conversion service, as columns and batch queries."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types that are routed behind, formats that always run behind, limits, and secret options.
AUDIO_TYPES = ("audio/mpeg", "audio/wav", "audio/mp4", "audio/flac", "audio/ogg", "video/mp4")
ALWAYS_BEHIND = ("audio/mpeg", "audio/wav", "audio/mp4", "audio/flac", "audio/ogg", "scanned_pdf")
SECRETS = ("llm_api_key", "hf_token", "vision_api_key", "access_token", "google_credentials", "openai_api_key", "anthropic_api_key")
LARGE_BYTES = 10 * 1024 * 1024
JOB_TTL = 3600
OUTPUTS = ("markdown", "chunks", "json", "html")
IMAGE_MODES = ("extract", "suppress", "caption", "inline_ocr")
HEARTBEAT, LONGEST = 15, 3600
#: (stage, percent) in the order of a plain run, and those that audio adds.
STAGES = (("routing", 2), ("parsing", 10), ("quality_check", 85), ("rendering", 90), ("delivering_webhook", 95), ("completed", 100))
AUDIO_STAGES = (("audio_quality_check", 5), ("transcribing", 10), ("diarizing", 70), ("speaker_matching", 75), ("structuring", 80), ("topic_segmentation", 82))


def route(size: Column, mime: Column, priority: Column, large: int = LARGE_BYTES) -> Column:
    """The queue of an upload: a stated priority, then audio, then size. An unknown priority has none."""
    by_type = F.when(F.coalesce(mime.isin(*AUDIO_TYPES), F.lit(False)), "batch").when(F.coalesce(size > large, F.lit(False)), "batch").otherwise("interactive")
    return F.when(priority.isNull(), by_type).when(priority.isin("interactive", "batch"), priority)


def runs_behind(size: Column, kind: Column, broker_up: Column, large: int = LARGE_BYTES) -> Column:
    """Whether an upload is handed to a worker."""
    return F.coalesce(broker_up, F.lit(False)) & (F.coalesce(kind.isin(*ALWAYS_BEHIND), F.lit(False)) | F.coalesce(size > large, F.lit(False)))


def latest_jobs(updates: DataFrame) -> DataFrame:
    """(job_id, status, queue, created_at, updated_at): each job's last update and first time."""
    last = F.max_by(F.struct("status", "queue"), "updated_at")
    return updates.groupBy("job_id").agg(last.alias("last"), F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at")).select("job_id", "last.status", "last.queue", "created_at", "updated_at")


def live_jobs(jobs: DataFrame, now: Column, ttl: int = JOB_TTL) -> DataFrame:
    return jobs.where(now - F.col("updated_at") < ttl)


def stream_status(status: Column) -> Column:
    """The event vocabulary of a stored status."""
    return F.when(status == "complete", "completed").when(status == "callback_failed", "failed").otherwise(status)


def is_terminal(status: Column) -> Column:
    return status.isin("complete", "completed", "failed", "callback_failed")


def progress_json(events: DataFrame) -> DataFrame:
    """Events with ``body``: their JSON without absent fields."""
    return events.withColumn("body", F.to_json(F.struct("job_id", "status", "queue", "ts", "stage", "pct", "message")))


def until_terminal(events: DataFrame) -> DataFrame:
    """A job's events up to its first final one, and none after."""
    ends = F.expr("min(case when status in ('completed', 'failed') then ts end) over (partition by job_id)")
    return events.withColumn("ends", ends).where(F.col("ends").isNull() | (F.col("ts") <= F.col("ends"))).drop("ends")


def heartbeats(events: DataFrame, every: int = HEARTBEAT) -> DataFrame:
    """(job_id, ts, beats): how many heartbeats fall in the silence before each event."""
    gap = F.expr("ts - lag(ts) over (partition by job_id order by ts)")
    return events.withColumn("gap", gap).where(F.col("gap") >= every).select("job_id", "ts", F.floor(F.col("gap") / every).cast("int").alias("beats"))


def callback_problem(url: Column) -> Column:
    """Why a callback address is refused, or null: https only, a host, and no literal address of a closed network."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    n = lambda i: F.split_part(host, F.lit("."), F.lit(i)).try_cast("int")
    closed = n(1).isin(0, 10, 127) | ((n(1) == 172) & n(2).between(16, 31)) | ((n(1) == 192) & (n(2) == 168)) | ((n(1) == 169) & (n(2) == 254)) | ((n(1) == 192) & (n(2) == 0) & n(3).isin(0, 2)) | ((n(1) == 198) & (n(2).isin(18, 19))) | ((n(1) == 198) & (n(2) == 51) & (n(3) == 100)) | ((n(1) == 203) & (n(2) == 0) & (n(3) == 113)) | (n(1) >= 240)
    inner = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    closed6 = inner.rlike(r"^(::1?|0*(:0*)*:0*1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:(10|127|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\..*|2001:0?db8:.*|100::.*)$")
    return (
        F.when(~F.coalesce(F.startswith(F.lower(url), F.lit("https://")), F.lit(False)), "not https")
        .when(host == "", "no host")
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")), "localhost")
        .when(v4 & F.coalesce(closed, F.lit(False)), "closed network")
        .when((inner != "") & closed6, "closed network")
    )


def redacted(options: Column) -> Column:
    """A map of options with the values of secret keys struck out."""
    return F.transform_values(options, lambda k, v: F.when(k.isin(*SECRETS), "***").otherwise(v))


def redacted_nested(options: Column) -> Column:
    """Options with a nested map ``extra``, both without secrets: a struct of ``plain`` and ``extra`` maps."""
    return F.struct(redacted(options["plain"]).alias("plain"), redacted(options["extra"]).alias("extra"))


def redacted_url(url: Column) -> Column:
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit("/***"))).otherwise("***")


def scrubbed(message: Column, key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) != "", F.replace(message, key, F.lit("***"))).otherwise(message)


def request_problem(output: Column, images: Column, extension: Column, priority: Column, schema: Column, known: tuple[str, ...]) -> Column:
    """The first thing wrong with a conversion request, or null."""
    bad = lambda c, allowed: c.isNotNull() & ~c.isin(*allowed)
    return (
        F.when(bad(output, OUTPUTS), "unknown output format")
        .when(bad(images, IMAGE_MODES), "unknown image mode")
        .when(~F.lower(extension).isin(*known), "unsupported file type")
        .when(bad(F.lower(priority), ("interactive", "batch")), "unknown priority")
        .when(schema.isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(schema)).rlike(r"^OBJECT<.+>$"), F.lit(False)), "schema must be a non-empty object")
    )


def envelope(results: DataFrame, output: str = "markdown") -> DataFrame:
    """(doc_id, body): the answer of a conversion as JSON."""
    stats = F.struct(F.col("metadata.word_count").alias("words"), F.col("metadata.page_count").alias("pages"), F.col("metadata.slide_count").alias("slides"), F.col("metadata.sheet_count").alias("sheets"), F.upper("metadata.source_format").alias("format"))
    return results.select("doc_id", F.to_json(F.struct("quality", stats.alias("stats"), "warnings", F.col(output))).alias("body"))


def error_is_transient(kind: Column) -> Column:
    """Errors that are worth a further attempt: of files and connections, not of parsing."""
    return kind.isin("OSError", "IOError", "ConnectionError", "TimeoutError", "BrokenPipeError")


def progress_channel(job_id: Column, prefix: str = "progress.") -> Column:
    return F.concat(F.lit(prefix), job_id)


@contextmanager
def scheduler_pool(spark: SparkSession, queue: str):
    """Jobs started inside run in the queue's own scheduler pool (with ``spark.scheduler.mode=FAIR``)."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", queue)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)


def stage_table(spark: SparkSession, audio: bool = False) -> DataFrame:
    """(stage, pct) that a run reports; an audio run adds its own, whose percents don't only rise."""
    return spark.createDataFrame([*STAGES[:2], *(AUDIO_STAGES if audio else ()), *STAGES[2:]], "stage string, pct int")

"""Transcripts: silent gaps, speakers, topics, and the health of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import clock, strip

SILENCE = 30.0
BATCH = 20
LEAST_PARAGRAPHS = 3
LOW_KBPS, LONG_SECONDS, LOW_HERTZ = 32, 14_400, 8000
#: Seconds of the spans in which segments meet turns.
MEETING = 30


def spoken(segments: DataFrame) -> DataFrame:
    return segments.where(strip(F.coalesce("text", F.lit(""))) != "")


def silence_sections(segments: DataFrame, gap: float = SILENCE) -> DataFrame:
    """Spoken segments with ``section`` (from 0) and ``heading`` (when the section starts): a new one after each long gap."""
    own = spoken(segments).selectExpr("*", "lag(`end`) over (partition by doc_id order by seg_no) as before")
    own = own.withColumn("opens", F.when(F.col("before").isNotNull() & (F.col("start") - F.col("before") > gap), 1).otherwise(0))
    own = own.withColumn("section", F.expr("cast(sum(opens) over (partition by doc_id order by seg_no rows unbounded preceding) as int)"))
    first = F.expr("min_by(start, seg_no) over (partition by doc_id, section)")
    return own.withColumn("heading", F.concat(F.lit("["), clock(first), F.lit("]"))).drop("before", "opens")


def turn_markdown(segments: DataFrame) -> DataFrame:
    """Spoken segments with ``line``: time and speaker in bold, then the text."""
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("] "), F.col("speaker"), F.lit(":** "))).otherwise("]:** ")
    return spoken(segments).withColumn("line", F.concat(F.lit("**["), clock(F.col("start")), who, strip(F.col("text"))))


def speaker_labels(turns: DataFrame) -> DataFrame:
    """(doc_id, raw_label, speaker): voices named by the order in which they first speak."""
    first = turns.groupBy("doc_id", "raw_label").agg(F.min("turn_no").alias("first"))
    return first.selectExpr("doc_id", "raw_label", "concat('Speaker ', char(64 + cast(rank() over (partition by doc_id order by first) as int))) as speaker")


def match_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments with the speaker of the first turn that holds their midpoint, ends included; null if none does.

    They meet by spans of ``MEETING`` seconds, so a long recording isn't compared with itself as a whole."""
    named = turns.join(speaker_labels(turns), ["doc_id", "raw_label"])
    span = lambda seconds: F.floor(seconds / MEETING)
    mid = (F.col("start") + F.col("end")) / 2
    s = segments.drop("speaker").withColumn("mid", mid).withColumn("span", span(F.col("mid"))).alias("s")
    t = named.where("start <= end").withColumn("span", F.explode(F.sequence(span(F.col("start")), span(F.col("end"))))).alias("t")
    inside = (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("s.span") == F.col("t.span")) & F.col("s.mid").between(F.col("t.start"), F.col("t.end"))
    found = s.join(t, inside).groupBy(F.col("s.doc_id").alias("doc_id"), F.col("s.seg_no").alias("seg_no")).agg(F.min_by("t.speaker", "t.turn_no").alias("speaker"))
    return segments.drop("speaker").join(found, ["doc_id", "seg_no"], "left")


def topic_batches(paragraphs: DataFrame, size: int = BATCH) -> DataFrame:
    """Paragraphs (doc_id, pos) of documents with enough of them, with ``batch`` and ``local``, both from 0."""
    own = paragraphs.selectExpr("*", "cast(row_number() over (partition by doc_id order by pos) - 1 as int) as place", "count(*) over (partition by doc_id) as n")
    return own.where(F.col("n") >= LEAST_PARAGRAPHS).withColumn("batch", F.floor(F.col("place") / size).cast("int")).withColumn("local", (F.col("place") % size).cast("int")).drop("n", "place")


def topic_sections(batched: DataFrame, topics: DataFrame) -> DataFrame:
    """Paragraphs with the topic whose range (doc_id, batch, start_index, end_index, topic) holds them.

    The first range wins where some overlap, and what no range holds is ``Uncategorised``: no paragraph is lost or doubled."""
    b, t = batched.alias("b"), topics.alias("t")
    inside = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.batch") == F.col("t.batch")) & F.col("b.local").between(F.col("t.start_index"), F.col("t.end_index"))
    found = b.join(t, inside).groupBy(F.col("b.doc_id").alias("doc_id"), F.col("b.pos").alias("pos")).agg(F.min_by("t.topic", F.struct("t.start_index", "t.end_index")).alias("topic"))
    return batched.join(found, ["doc_id", "pos"], "left").withColumn("topic", F.coalesce("topic", F.lit("Uncategorised")))


def rebased(segments: DataFrame) -> DataFrame:
    """Segments of a recording's parts with times from its beginning; ``chunk_offset`` is when the part starts."""
    return segments.withColumn("start", F.col("start") + F.col("chunk_offset")).withColumn("end", F.col("end") + F.col("chunk_offset")).drop("chunk_offset")


def recording_warnings(recordings: DataFrame) -> DataFrame:
    """(doc_id, type, message) for recordings (doc_id, size, duration, channels, sample_rate) that are poor or long."""
    kbps = F.floor(F.col("size") * 8 / F.greatest("duration", F.lit(0.001)) / 1000).cast("int")
    found = F.filter(
        F.array(
            F.when(kbps < LOW_KBPS, F.struct(F.lit("audio_quality").alias("type"), F.concat(F.lit("Low bitrate: "), kbps.cast("string"), F.lit(" kbps")).alias("message"))),
            F.when(F.col("duration") > LONG_SECONDS, F.struct(F.lit("audio_duration").alias("type"), F.concat(F.lit("Long recording: "), F.col("duration").cast("long").cast("string"), F.lit(" s")).alias("message"))),
            F.when((F.col("channels") == 1) & (F.col("sample_rate") <= LOW_HERTZ), F.struct(F.lit("audio_quality").alias("type"), F.lit("Telephone quality: one channel at 8 kHz or less").alias("message"))),
        ),
        lambda w: w.isNotNull(),
    )
    return recordings.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.type", "w.message")

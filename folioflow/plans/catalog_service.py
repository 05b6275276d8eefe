"""Queries on transcripts, jobs and requests, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import paragraphs, service, transcript
from folioflow.plans import assemble, render
from folioflow.plans.catalog_text import _PARAGRAPHS, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


#: Turns as segments: a second a word, a pause of forty seconds before each third turn.
_SEGMENTS = r"""seg AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS seg_no, text, role AS speaker, CAST(sum(w) OVER o - w + 40 * (turn // 3) AS DOUBLE) AS start, CAST(sum(w) OVER o + 40 * (turn // 3) AS DOUBLE) AS "end"
  FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+')) AS w FROM conversations) WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"""


def segments(spark, d):
    c = table(spark, d, "conversations").withColumn("w", T.word_count(F.col("text")))
    total = F.expr("sum(w) over (partition by conv_id order by turn)")
    own = c.withColumn("total", total)
    return own.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("seg_no"), "text", F.col("role").alias("speaker"), F.expr("cast(total - w + 40 * (turn div 3) as double)").alias("start"), F.expr("cast(total + 40 * (turn div 3) as double)").alias("end"))


_CLOCK = "printf('%02d:%02d', CAST(floor({0}) AS BIGINT) // 60, CAST(floor({0}) AS BIGINT) % 60)"


@query("speaker_turns_md", f"""WITH {_SEGMENTS}
SELECT doc_id, seg_no, '**[' || {_CLOCK.format('start')} || CASE WHEN coalesce(speaker, '') <> '' THEN '] ' || speaker || ':** ' ELSE ']:** ' END || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM seg WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def speaker_turns_md(spark, d):
    return transcript.turn_markdown(segments(spark, d)).select("doc_id", "seg_no", "line")


@query("silence_sections", f"""WITH {_SEGMENTS},
s AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY seg_no) AS before FROM seg WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
g AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND start - before > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_no) AS section FROM s)
SELECT doc_id, seg_no, CAST(section AS INTEGER) AS section, '[' || {_CLOCK.format('first_value(start) OVER (PARTITION BY doc_id, section ORDER BY seg_no)')} || ']' AS heading FROM g""")
def silence_sections(spark, d):
    return transcript.silence_sections(segments(spark, d)).select("doc_id", "seg_no", "section", "heading")


@query("speaker_midpoint_match", f"""WITH {_SEGMENTS},
t AS (SELECT doc_id, seg_no AS turn_no, start + 2 AS start, "end" + 2 AS "end", speaker AS raw FROM seg WHERE seg_no % 4 <> 3),
l AS (SELECT doc_id, raw, 'Speaker ' || chr(CAST(64 + rank() OVER (PARTITION BY doc_id ORDER BY min(turn_no)) AS INTEGER)) AS speaker FROM t GROUP BY doc_id, raw),
m AS (SELECT s.doc_id, s.seg_no, arg_min(l.speaker, t.turn_no) AS speaker FROM seg s JOIN t ON t.doc_id = s.doc_id AND (s.start + s."end") / 2 BETWEEN t.start AND t."end" JOIN l ON l.doc_id = t.doc_id AND l.raw = t.raw GROUP BY 1, 2)
SELECT seg.doc_id, seg.seg_no, m.speaker FROM seg LEFT JOIN m USING (doc_id, seg_no)""")
def speaker_midpoint_match(spark, d):
    s = segments(spark, d)
    turns = s.where("seg_no % 4 <> 3").select("doc_id", F.col("seg_no").alias("turn_no"), (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"), F.col("speaker").alias("raw_label"))
    return transcript.match_speakers(s, turns).select("doc_id", "seg_no", "speaker")


@query("topic_batches", f"""WITH {_PARAGRAPHS}, c AS (SELECT doc_id, count(*) AS k FROM p GROUP BY 1)
SELECT p.doc_id, CAST(p.n - 1 AS INTEGER) AS pos, CAST((n - 1) // 20 AS INTEGER) AS batch, CAST((n - 1) % 20 AS INTEGER) AS local FROM p JOIN c USING (doc_id) WHERE k >= 3""")
def topic_batches(spark, d):
    return transcript.topic_batches(paragraphs.paragraphs(table(spark, d, "documents"))).select("doc_id", "pos", "batch", "local")


@query("topic_sections", f"""WITH {_PARAGRAPHS}, c AS (SELECT doc_id, count(*) AS k FROM p GROUP BY 1)
SELECT p.doc_id, CAST(p.n - 1 AS INTEGER) AS pos, CASE WHEN (n - 1) % 20 <= 4 THEN 'opening' WHEN (n - 1) % 20 BETWEEN 8 AND 12 THEN 'middle' ELSE 'Uncategorised' END AS topic FROM p JOIN c USING (doc_id) WHERE k >= 3""")
def topic_sections(spark, d):
    batched = transcript.topic_batches(paragraphs.paragraphs(table(spark, d, "documents")))
    ranges = F.inline(F.array(*[F.struct(F.lit(a).alias("start_index"), F.lit(b).alias("end_index"), F.lit(t).alias("topic")) for a, b, t in ((0, 4, "opening"), (4, 4, "late"), (8, 12, "middle"))]))
    topics = batched.select("doc_id", "batch").distinct().select("doc_id", "batch", ranges)
    return transcript.topic_sections(batched, topics).select("doc_id", "pos", "topic")


@query("recording_warnings", """
SELECT doc_id, unnest(list_filter([CASE WHEN kbps < 32 THEN 'Low bitrate: ' || kbps || ' kbps' END, CASE WHEN du > 14400 THEN 'Long recording: ' || CAST(floor(du) AS BIGINT) || ' s' END, CASE WHEN ch = 1 AND sr <= 8000 THEN 'Telephone quality: one channel at 8 kHz or less' END], lambda x: x IS NOT NULL)) AS message
FROM (SELECT *, CAST(floor(sz * 8 / greatest(du, 0.001) / 1000) AS INTEGER) AS kbps FROM (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(p_size * 1000000 AS BIGINT) AS sz, CAST(p_partkey * 13 % 20000 AS DOUBLE) AS du, p_partkey % 2 + 1 AS ch, CASE WHEN p_size < 20 THEN 8000 ELSE 44100 END AS sr FROM part))""")
def recording_warnings(spark, d):
    p = table(spark, d, "part").selectExpr("cast(p_partkey as string) as doc_id", "cast(p_size as bigint) * 1000000 as size", "cast(p_partkey * 13 % 20000 as double) as duration", "p_partkey % 2 + 1 as channels", "if(p_size < 20, 8000, 44100) as sample_rate")
    return transcript.recording_warnings(p).select("doc_id", "message")


_STATUS = "CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'queued' END"
_UPDATES = f"SELECT CAST(user_id AS VARCHAR) AS job_id, {_STATUS} AS status, event_id, CAST(event_id * 7 AS DOUBLE) AS seen_at FROM events"


def _updates(spark, d):
    e = table(spark, d, "events")
    return e.selectExpr("cast(user_id as string) as job_id", f"{_STATUS} as status", "if(event_id % 2 = 0, 'interactive', 'batch') as queue", "cast(event_id * 7 as double) as updated_at", "event_id")


@query("job_latest_state", f"WITH u AS ({_UPDATES}) SELECT job_id, arg_max(status, seen_at) AS status, CASE WHEN max(event_id) % 2 = 0 THEN 'interactive' ELSE 'batch' END AS queue, min(seen_at) AS created_at, max(seen_at) AS updated_at FROM u GROUP BY job_id")
def job_latest_state(spark, d):
    return service.latest_jobs(_updates(spark, d))


@query("job_ttl", f"WITH u AS ({_UPDATES}), j AS (SELECT job_id, max(seen_at) AS updated_at FROM u GROUP BY 1) SELECT job_id, updated_at FROM j WHERE (SELECT max(seen_at) FROM u) - updated_at < 3600")
def job_ttl(spark, d):
    u = _updates(spark, d)
    now = u.agg(F.max("updated_at").alias("now"))
    return service.live_jobs(service.latest_jobs(u).join(F.broadcast(now)), F.col("now")).select("job_id", "updated_at")


def _events(spark, d):
    return _updates(spark, d).select("job_id", service.stream_status(F.col("status")).alias("status"), F.col("updated_at").alias("ts"))


_STREAM = "CASE status WHEN 'complete' THEN 'completed' ELSE status END"


@query("progress_terminal", f"WITH u AS (SELECT job_id, {_STREAM} AS status, seen_at AS ts FROM ({_UPDATES})), e AS (SELECT job_id, min(ts) AS ends FROM u WHERE status IN ('completed', 'failed') GROUP BY 1) SELECT u.* FROM u LEFT JOIN e USING (job_id) WHERE ends IS NULL OR ts <= ends")
def progress_terminal(spark, d):
    return service.until_terminal(_events(spark, d))


@query("heartbeat_gaps", f"SELECT job_id, ts, CAST(floor(gap / 15) AS INTEGER) AS beats FROM (SELECT job_id, seen_at AS ts, seen_at - lag(seen_at) OVER (PARTITION BY job_id ORDER BY seen_at) AS gap FROM ({_UPDATES})) WHERE gap >= 15")
def heartbeat_gaps(spark, d):
    return service.heartbeats(_events(spark, d))


@query("progress_json", """SELECT event_id, '{"job_id":"' || user_id || '","status":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"pct":' || event_id % 100 ELSE '' END || '}' AS body FROM events""")
def progress_json(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "cast(user_id as string) as job_id", "event_type as status", "cast(null as string) as queue", "cast(null as string) as ts", "cast(null as string) as stage", "if(event_id % 2 = 0, event_id % 100, null) as pct", "cast(null as string) as message")
    return service.progress_json(e).select("event_id", "body")


@query("route_jobs", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'batch' WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'batch' WHEN p_partkey * 9000 > 10485760 THEN 'batch' ELSE 'interactive' END AS queue FROM part""")
def route_jobs(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", service.route(F.expr("p_partkey * 9000"), F.expr("if(p_partkey % 5 = 0, 'audio/ogg', 'text/html')"), F.expr("case when p_partkey % 7 = 0 then 'batch' when p_partkey % 11 = 0 then 'urgent' end")).alias("queue"))


@query("sync_or_async", "SELECT p_partkey, p_size % 2 = 0 AND (p_partkey % 5 = 0 OR p_partkey * 9000 > 10485760) AS behind FROM part")
def sync_or_async(spark, d):
    return table(spark, d, "part").select("p_partkey", service.runs_behind(F.expr("p_partkey * 9000"), F.expr("if(p_partkey % 5 = 0, 'scanned_pdf', 'text/html')"), F.expr("p_size % 2 = 0")).alias("behind"))


@query("redact_fields", "SELECT c_custkey, '***' AS api_key, c_name AS name, 'https://' || lower(c_mktsegment) || '.example.com/***' AS hook FROM customer")
def redact_fields(spark, d):
    c = table(spark, d, "customer")
    held = service.redacted(F.create_map(F.lit("llm_api_key"), F.col("c_name"), F.lit("name"), F.col("c_name")))
    return c.withColumn("m", held).select("c_custkey", F.col("m.llm_api_key").alias("api_key"), F.col("m.name").alias("name"), service.redacted_url(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/hook?key=1"))).alias("hook"))


@query("callback_valid", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'closed network' WHEN 1 THEN 'closed network' WHEN 2 THEN 'localhost' WHEN 3 THEN 'closed network' WHEN 4 THEN 'closed network' WHEN 5 THEN NULL ELSE CASE WHEN url LIKE 'https://%' THEN NULL ELSE 'not https' END END AS problem FROM pages""")
def callback_valid(spark, d):
    url = F.expr("case page_id % 8 when 0 then 'https://10.1.2.3/x' when 1 then 'https://169.254.169.254/latest' when 2 then 'https://localhost:8080/x' when 3 then 'https://[::1]/x' when 4 then 'https://172.20.0.1' when 5 then 'https://93.184.216.34/x' else url end")
    return table(spark, d, "pages").select("page_id", service.callback_problem(url).alias("problem"))


@query("progress_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def progress_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


@query("transcript_markdown", rf"""WITH {_SEGMENTS},
s AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY seg_no) AS before FROM seg WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
g AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND start - before > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_no) AS section FROM s),
h AS (SELECT *, section > 0 AND row_number() OVER (PARTITION BY doc_id, section ORDER BY seg_no) = 1 AS opens FROM g)
SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || string_agg(CASE WHEN opens THEN '## [' || {_CLOCK.format('start')} || ']' || chr(10) || chr(10) ELSE '' END || '**[' || {_CLOCK.format('start')} || '] ' || speaker || ':** ' || replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '|', '\|'), chr(10) || chr(10) ORDER BY seg_no) AS markdown FROM h GROUP BY doc_id""")
def transcript_markdown(spark, d):
    return render.markdown(assemble.transcript_nodes(segments(spark, d)))


@query("page_documents", f"""WITH {_PARAGRAPHS}, g AS (SELECT doc_id, source, string_agg(replace(paragraph, '|', '\\|'), chr(10) || chr(10) ORDER BY n) AS body FROM p GROUP BY 1, 2)
SELECT source AS doc_id, string_agg('## Page ' || doc_id || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY doc_id) AS markdown FROM g GROUP BY source""")
def page_documents(spark, d):
    lines = paragraphs.paragraphs(table(spark, d, "documents").select(F.struct("source", "doc_id").alias("doc_id"), "text"))
    return render.markdown(assemble.page_nodes(lines.select(F.col("doc_id.source").alias("doc_id"), F.col("doc_id.doc_id").alias("page_number"), "pos", F.col("paragraph").alias("text"))))

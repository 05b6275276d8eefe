"""Streams, and the interfaces to services."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.plans.convert import Options
from folioflow.sources import external
from folioflow.streaming import jobs


def test_transitions():
    first = jobs.apply_update(None, {"status": None, "ts": 5.0})
    assert first == ("queued", None, None, None, 5.0, 5.0)
    done = jobs.apply_update(first, {"status": "complete", "result": "r", "ts": 9.0, "queue": None})
    assert done == ("complete", None, "r", None, 5.0, 9.0)


def run_stream(spark, frame, tmp_path, name, enough, seconds=120):
    """Rows of a stream once there are enough; with processing-time timers a stream has no end of its own."""
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("update").trigger(processingTime="1 second").start()
    try:
        ends = time.time() + seconds
        while time.time() < ends and q.isActive:
            rows = spark.table(name).collect()
            if enough(rows):
                break
            time.sleep(0.5)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_job_stream(spark, tmp_path):
    pd.DataFrame([("a", "queued", "batch", None, None, 1.0), ("a", "complete", None, "r", None, 3.0), ("b", "queued", None, None, None, 2.0)], columns=["job_id", "status", "queue", "result", "error", "ts"]).to_json(tmp_path / "u.json", orient="records", lines=True)
    updates = spark.readStream.schema(jobs.UPDATE).json(str(tmp_path / "*.json"))
    got = {r.job_id: r for r in run_stream(spark, jobs.job_states(updates), tmp_path, "jobs", lambda rows: len(rows) >= 2)}
    assert got["a"].status == "complete" and got["a"].queue == "batch" and got["a"].result == "r" and got["a"].created_at == 1.0 and got["b"].status == "queued"


def test_progress_relay(spark, tmp_path):
    rows = [("a", "processing", "parsing", 10, None), ("a", "completed", "completed", 100, None), ("b", "processing", "parsing", 10, "m")]
    pd.DataFrame(rows, columns=["job_id", "status", "stage", "pct", "message"]).to_json(tmp_path / "e.json", orient="records", lines=True)
    events = spark.readStream.schema("job_id string, status string, stage string, pct int, message string").json(str(tmp_path / "*.json"))
    ended = lambda rows: any(r.kind == "timeout" for r in rows)
    got = run_stream(spark, jobs.progress_stream(events, beat=1, longest=6), tmp_path, "progress", ended)
    assert {r.job_id for r in got if r.kind == "heartbeat"} == {"b"} and [r.job_id for r in got if r.kind == "timeout"] == ["b"]
    assert sorted((r.job_id, r.kind, r.pct) for r in got if r.kind == "event") == [("a", "event", 10), ("a", "event", 100), ("b", "event", 10)]


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "a")], "ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in jobs.windowed_progress(rows).collect()) == [1, 2]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>A</h1><p>b</p>")
    from folioflow.sources.registry import extension

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in")).select(F.md5("path").alias("doc_id"), F.col("path").alias("source"), extension(F.col("path")).alias("ext"), "content")
    got = []
    q = jobs.convert_arrivals(files, lambda frame, n: got.extend(r.markdown for r in frame.collect()), Options()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and got == ["# A\n\nb"]


def test_services_answer_or_say_why(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "secret fails"), (3, None)], "i int, p string")

    def echo(text):
        if "fails" in text:
            raise ValueError("key K was refused")
        return text.upper()

    got = [(r.a.value, r.a.error) for r in rows.select("i", external.ask(F.col("p"), echo, attempts=2, pause=0.0, secret="K").alias("a")).orderBy("i").collect()]
    assert got == [("HELLO", None), (None, "key *** was refused"), (None, None)]
    assert rows.where("i = 1").select(external.ask(F.col("p")).alias("a")).first().a.error == "no service was provided"


def test_extraction_asks_twice(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "second"), (3, "never")], "i int, markdown string")

    def model(prompt):
        if "good" in prompt or ("second" in prompt and "no JSON object" in prompt):
            return '```json\n{"a": 1}\n```'
        return "[1]"

    got = [(r.extracted, r.extract_error) for r in external.extract_fields(rows, "{}", model).orderBy("i").collect()]
    assert got == [('{"a": 1}', None), ('{"a": 1}', None), (None, "no JSON object in the answer")]


def test_topic_answers(spark):
    rows = spark.createDataFrame([('[{"start_index": 0, "end_index": 2, "topic": "t"}]',), ('[{"start_index": 0}]',), ("nonsense",), ("[]",)], "a string")
    assert [r.r is not None for r in rows.select(external.topic_ranges(F.col("a")).alias("r")).collect()] == [True, False, False, False]


def test_cascade_and_transcripts(spark):
    pages = spark.createDataFrame([("p", "scan.png")], "doc_id string, image_path string")

    def broken(_):
        raise OSError("not installed")

    got = external.recognise(pages, {"first": broken, "second": lambda p: "text"}).first()
    assert got.text == "text" and got.engine == "second"
    with pytest.raises(LookupError):
        external.recognise(pages, {}, "x")
    rec = spark.createDataFrame([("a", "ok.wav"), ("b", "bad.wav")], "doc_id string, path string")
    segs = external.transcribe(rec, "e", {"e": lambda p: [("hi", 0, 1)] if p == "ok.wav" else broken(p)}).collect()
    assert [(r.doc_id, r.text, r.end) for r in segs] == [("a", "hi", 1.0)]
    with pytest.raises(ValueError):
        external.transcribe(rec, "none", {})


def test_downloads_and_deliveries(spark):
    i = "1AbCdEfGhIjKlMnOpQrStUvWxYz_-012345"
    rows = spark.createDataFrame([("a", f"https://x.example.com/d/{i}/edit"), ("b", "no id")], "doc_id string, source string")
    got = {r.doc_id: r for r in external.fetch(rows, lambda f: f.encode()).collect()}
    assert bytes(got["a"].content) == i.encode() and got["b"].error == "no file id"
    assert external.fetch(rows, external.refuse).where("doc_id = 'a'").first().error == "no service was provided"
    posts = spark.createDataFrame([("j", "u", "x"), ("k", "bad", "x")], "job_id string, url string, body string")
    sent = {r.job_id: (r.delivered, r.attempts) for r in external.deliver(posts, lambda u, b: 200 if u == "u" else 500, pauses=(0.0,)).collect()}
    assert sent == {"j": (True, 1), "k": (False, 3)}


def test_written_files(spark, tmp_path):
    folder = str(tmp_path)

    def put(name, content):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)

    rows = spark.createDataFrame([("a.png", bytearray(b"x")), ("no/such/b.png", bytearray(b"y"))], "name string, content binary")
    got = {r.name: r.error for r in external.write_files(rows, put).collect()}
    assert got["a.png"] is None and "No such file" in got["no/such/b.png"] and (tmp_path / "a.png").read_bytes() == b"x"

"""Operators on grids, pages, transcripts, jobs and requests."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import images, paragraphs, service, tables, transcript


def grid_rows(spark, grid):
    return spark.createDataFrame([("t", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "table_id string, row int, col int, value string")


@pytest.mark.parametrize(
    "grid, kept",
    [
        ([["", " "], ["", ""]], 0), ([["a", "", ""], ["b", "", ""]], 0), ([["a", "b", ""], ["c", "d", ""]], 2), ([["a", ""], ["b", ""]], 2), ([["x" * 201]], 0), ([["a"], ["b"], ["c"]], 3),
        ([["x" * 90, "y" * 90], ["z" * 90, "w" * 90]], 0), ([["x" * 100] * 4] * 2, 2), ([["x" * 80] * 2] * 2, 2), ([["p" * 100, ""], ["a", "b"], ["c", "d"]], 2), ([["p" * 70, ""], ["a", "b"]], 2),
    ],
)
def test_plausible(spark, grid, kept):
    assert tables.plausible_rows(grid_rows(spark, grid)).select("row").distinct().count() == kept


def test_trim_and_merge(spark):
    cells = spark.createDataFrame([("d", "s", r, c, v) for r, row in enumerate([["A", "", ""], ["1", "2", " "], ["", "", ""]]) for c, v in enumerate(row)], "doc_id string, sheet string, row int, col int, value string")
    got = {(r.row, r.col): r.value for r in tables.trim(cells).collect()}
    assert got == {(0, 0): "A", (0, 1): "", (1, 0): "1", (1, 1): "2"}
    merges = spark.createDataFrame([("d", "s", 0, 0, 0, 1)], "doc_id string, sheet string, min_row int, min_col int, max_row int, max_col int")
    assert {(r.row, r.col): r.value for r in tables.fill_merged(cells, merges).collect()}[0, 1] == "A"
    own = tables.grids(tables.trim(cells), ("doc_id", "sheet")).first().grid
    assert own == [["A", ""], ["1", "2"]]


def test_cap(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 0)], "k string, i int")
    got = tables.cap_rows(rows, ("k",), "i", 5).collect()
    assert sorted((r.k, r.i, r.truncated, r.total_rows) for r in got) == [("a", i, True, 7) for i in range(5)] + [("b", 0, False, None)]
    assert tables.cap_rows(rows, ("k",), "i", 0).count() == 8


def test_formula_cache(spark):
    cells = spark.createDataFrame([("d", "s", None, True), ("d", "s", "x", False), ("d", "t", "1", True)], "doc_id string, sheet string, value string, is_formula boolean")
    assert [(r.doc_id, r.sheet) for r in tables.without_formula_cache(cells).collect()] == [("d", "s")]


def test_merged_answer(spark):
    pairs = spark.createDataFrame([(1, "| a |\n| --- |\n| 1 |"), (2, " separate "), (3, None)], "i int, answer string")
    assert [r.merged for r in tables.merge_tables(pairs, F.col("answer")).orderBy("i").collect()] == [[["a"], ["1"]], None, None]


@pytest.mark.parametrize(
    "text, share", [("clean text", 0.0), ("�" * 5 + "a" * 5, 0.5), ("" * 5 + " b", 5 / 6), ("", 0.0), (" \n", 0.0), (None, 0.0)]
)
def test_corruption(spark, text, share):
    assert spark.createDataFrame([(text,)], "t string").select(paragraphs.corruption(F.col("t")).alias("c")).first().c == pytest.approx(share)


def test_corrupt_and_math_pages(spark):
    pages = spark.createDataFrame([("d", 2, "�a"), ("d", 1, "��"), ("d", 3, "fine")], "doc_id string, page_number int, text string")
    assert paragraphs.corrupt_pages(pages).first().pages == [1, 2]
    chars = spark.createDataFrame([("few", 1, "a", "Times")] * 500 + [("few", 1, "∑", "Times")] + [("many", 4, "x", "Times")] * 150 + [("many", 4, "∑", "Times")] * 50 + [("font", 1, "x", "ABC+CMMI9")] * 3, "doc_id string, page_number int, text string, fontname string")
    assert {r.doc_id: r.pages for r in paragraphs.math_pages(chars).collect()} == {"many": [4], "font": [1]}


def test_rotation(spark):
    turned, flat = [0.0, 1.0, -1.0, 0.0], [1.0, 0.0, 0.0, 1.0]
    rows = [("d", 1, i, c, 100.0, turned) for i, c in enumerate("EULAV")] + [("d", 1, 5, "x", 0.0, flat), ("d", 1, 6, "q", 300.0, turned)]
    chars = spark.createDataFrame(rows, "doc_id string, page_number int, pos int, text string, x0 double, matrix array<double>")
    runs = paragraphs.rotated_runs(chars)
    assert [(r.wrong, r.right) for r in runs.collect()] == [("EULAV", "VALUE")]
    own = runs.agg(F.collect_list(F.struct("wrong", "right")).alias("runs")).withColumn("text", F.lit("a EULAV b EULAV"))
    assert own.select(paragraphs.turned_back(F.col("text"), F.col("runs")).alias("t")).first().t == "a VALUE b EULAV"


def test_promotion(spark):
    lines = spark.createDataFrame([("d", 1, 0, "Big"), ("d", 1, 1, "body"), ("d", 1, 2, "more"), ("e", 1, 0, "5"), ("f", 1, 0, "x" * 121), ("g", 1, 0, "nofont")], "doc_id string, page_number int, pos int, text string")
    fonts = spark.createDataFrame([("d", 1, 100, 24.0), ("d", 1, 200, 12.0), ("d", 1, 300, 12.0), ("e", 1, 0, 24.0), ("e", 1, 2, 10.0), ("e", 1, 4, 10.0), ("f", 1, 0, 24.0), ("f", 1, 2, 10.0), ("f", 1, 4, 10.0)], "doc_id string, page_number int, bucket int, size double")
    got = {(r.doc_id, r.pos): r.level for r in paragraphs.promoted_headings(lines, fonts).collect()}
    assert got == {("d", 0): 1, ("d", 1): None, ("d", 2): None, ("e", 0): None, ("f", 0): None, ("g", 0): None}


@pytest.mark.parametrize("words, pages, want", [(4, 1, True), (5, 1, False), (24, 5, True), (100, 5, False), (0, 0, False), (3, None, False)])
def test_scanned(spark, words, pages, want):
    row = spark.createDataFrame([(words, pages)], "w int, p int").select(paragraphs.scanned(F.col("w"), F.col("p")).alias("s")).first()
    assert row.s is want


def test_words_and_boxes(spark):
    words = spark.createDataFrame([("d", 1, "in", 10.0, 50.0, 100.0), ("d", 1, "cell", 12.0, 50.0, 100.0), ("d", 1, "body", 80.0, 50.0, 100.0), ("d", 1, "foot", 10.0, 95.0, 100.0)], "doc_id string, page_number int, text string, x0 double, top double, page_h double")
    boxes = spark.createDataFrame([("d", 1, 0.0, 20.0, 40.0, 60.0)], "doc_id string, page_number int, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in paragraphs.body_words(words, boxes).collect()] == ["body"]
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, 0.0, 20.0, 40.0, 60.0), ("d", 1, 0, 0, 1, None, None, None, None)], "doc_id string, page_number int, table_no int, row int, col int, x0 double, x1 double, top double, bottom double")
    assert {r.col: r.value for r in paragraphs.words_in_cells(words, cells).collect()} == {0: "in cell", 1: ""}


def test_layout_items(spark):
    items = spark.createDataFrame([("d", i, k, "x") for i, k in enumerate(["title", "text", "list_item", "list_item", "footnote", "list_item", "text", "list_item"])], "doc_id string, pos int, label string, text string")
    got = paragraphs.labelled_blocks(items).orderBy("pos").collect()
    assert [(r.kind, r.block) for r in got] == [("heading", 1), ("paragraph", 2), ("list", 3), ("list", 3), ("list", 3), ("paragraph", 4), ("list", 5)]


def test_recognised(spark):
    row = spark.createDataFrame([("a\nb\n\n42\n\n c \n",)], "t string").select(paragraphs.recognised_paragraphs(F.col("t")).alias("p")).first()
    assert row.p == ["a b", "c"]


@pytest.mark.parametrize(
    "kind, w, h, name, want",
    [("pptx", 9144000, 5143500, "", "decorative"), ("pptx", 2000000, 2000000, "", "unknown"), ("pptx", 1e6, 1e6, "Divider 3", "decorative"), ("pptx", 4e6, 1e5, "", "decorative"), ("pdf", 9e6, 5e6, "", "decorative"), ("pdf", 1e5, 1e5, "", "decorative"), ("docx", 0, 0, "Watermark", "decorative"), ("docx", 0, 0, "Figure", "unknown"), ("other", 1, 1, "bg_", "unknown")],
)
def test_image_kinds(spark, kind, w, h, name, want):
    row = spark.createDataFrame([(kind, float(w), float(h), name)], "k string, w double, h double, n string")
    got = row.select(images.image_kind(F.col("k"), F.col("w"), F.col("h"), F.lit(9144000.0), F.lit(5143500.0), F.col("n"), F.col("n")).alias("x")).first().x
    assert got == want


SEGMENT = "doc_id string, seg_no int, text string, start double, end double, speaker string"


def test_transcripts(spark):
    segs = spark.createDataFrame([("d", 0, "a", 0.0, 1.5, None), ("d", 1, " ", 2.0, 3.0, None), ("d", 2, "b", 2.0, 3.5, None), ("d", 3, "c", 40.0, 45.0, None), ("late", 0, "x", 50.0, 51.0, "S")], SEGMENT)
    got = [(r.doc_id, r.seg_no, r.section, r.heading) for r in transcript.silence_sections(segs).orderBy("doc_id", "seg_no").collect()]
    assert got == [("d", 0, 0, "[00:00]"), ("d", 2, 0, "[00:00]"), ("d", 3, 1, "[00:40]"), ("late", 0, 0, "[00:50]")]
    assert [r.line for r in transcript.turn_markdown(segs).orderBy("doc_id", "seg_no").collect()] == ["**[00:00]:** a", "**[00:02]:** b", "**[00:40]:** c", "**[00:50] S:** x"]
    turns = spark.createDataFrame([("d", 0, 0.0, 2.0, "S9"), ("d", 1, 2.0, 4.0, "S1"), ("d", 2, 2.5, 9.0, "S9")], "doc_id string, turn_no int, start double, end double, raw_label string")
    assert [r.speaker for r in transcript.match_speakers(segs, turns).orderBy("doc_id", "seg_no").collect()] == ["Speaker A", "Speaker B", "Speaker B", None, None]
    moved = transcript.rebased(segs.withColumn("chunk_offset", F.lit(600.0))).orderBy("doc_id", "seg_no").first()
    assert (moved.start, moved.end) == (600.0, 601.5)


def test_topics(spark):
    batched = transcript.topic_batches(spark.createDataFrame([("d", i) for i in range(45)] + [("two", 0), ("two", 1)], "doc_id string, pos int"))
    assert batched.count() == 45 and batched.where("batch = 2").count() == 5
    topics = spark.createDataFrame([("d", 0, 0, 2, "A"), ("d", 0, 2, 5, "B")], "doc_id string, batch int, start_index int, end_index int, topic string")
    got = [r.topic for r in transcript.topic_sections(batched, topics).orderBy("pos").collect()]
    assert got == ["A"] * 3 + ["B"] * 3 + ["Uncategorised"] * 39


def test_recordings(spark):
    rows = spark.createDataFrame([("ok", 10**7, 60.0, 2, 44100), ("bad", 1000, 20000.0, 1, 8000)], "doc_id string, size long, duration double, channels int, sample_rate int")
    assert sorted(r.type for r in transcript.recording_warnings(rows).collect()) == ["audio_duration", "audio_quality", "audio_quality"]


@pytest.mark.parametrize(
    "size, mime, priority, want", [(1024, "text/html", None, "interactive"), (20 << 20, "text/html", None, "batch"), (1, "audio/mpeg", None, "batch"), (20 << 20, "audio/mpeg", "interactive", "interactive"), (1, "x", "bad", None), (None, None, None, "interactive")]
)
def test_routes(spark, size, mime, priority, want):
    row = spark.createDataFrame([(size, mime, priority)], "s long, m string, p string")
    assert row.select(service.route(F.col("s"), F.col("m"), F.col("p")).alias("q")).first().q == want


@pytest.mark.parametrize(
    "url, good",
    [("https://example.com/x", True), ("http://example.com", False), ("https://localhost/x", False), ("https://127.0.0.1", False), ("https://10.0.0.1", False), ("https://172.16.0.9", False), ("https://172.32.0.9", True), ("https://192.168.1.1", False), ("https://169.254.1.1", False), ("https://[::1]/", False), ("https://[2606:4700::1111]/", True), ("https://[fe80::1]/", False), ("https:///x", False), (None, False), ("https://user@10.0.0.1:443/x", False)],
)
def test_callbacks(spark, url, good):
    got = spark.createDataFrame([(url,)], "u string").select(service.callback_problem(F.col("u")).alias("p")).first().p
    assert (got is None) is good


def test_requests_and_envelopes(spark):
    rows = spark.createDataFrame([("markdown", "extract", ".html", None, None), ("pdf", None, ".html", None, None), (None, "x", ".html", None, None), (None, None, ".zzz", None, None), (None, None, ".html", "now", None), (None, None, ".html", "batch", "{}"), (None, None, ".html", "batch", '{"a":1}')], "o string, i string, e string, p string, s string")
    got = [r.p for r in rows.select(service.request_problem(*(F.col(c) for c in "oieps"), (".html",)).alias("p")).collect()]
    assert [g is None for g in got] == [True, False, False, False, False, False, True]
    own = spark.createDataFrame([("d", "md", 1.0)], "doc_id string, markdown string, quality double").withColumn("metadata", F.expr("named_struct('word_count', 3, 'page_count', cast(null as int), 'slide_count', cast(null as int), 'sheet_count', 2, 'source_format', 'xlsx')")).withColumn("warnings", F.expr("array('w')"))
    assert service.envelope(own).first().body == '{"quality":1.0,"stats":{"words":3,"sheets":2,"format":"XLSX"},"warnings":["w"],"markdown":"md"}'
    assert spark.range(1).select(service.scrubbed(F.lit("key abc failed"), F.lit("abc")).alias("m")).first().m == "key *** failed"


def test_jobs(spark):
    rows = spark.createDataFrame([("a", "queued", "batch", 1.0), ("a", "complete", "batch", 9.0), ("b", "queued", None, 2.0)], "job_id string, status string, queue string, updated_at double")
    jobs = service.latest_jobs(rows)
    assert {r.job_id: (r.status, r.created_at, r.updated_at) for r in jobs.collect()} == {"a": ("complete", 1.0, 9.0), "b": ("queued", 2.0, 2.0)}
    assert [r.job_id for r in service.live_jobs(jobs, F.lit(3605.0)).collect()] == ["a"]

"""Pages and transcripts as documents, and the table of warnings."""

import hashlib
import time

from folioflow.__main__ import main
from folioflow.operators import paragraphs, service, tables
from folioflow.plans import assemble, render
from folioflow.sources.nodes import Outline
from tests.test_render import frames


def test_pages(spark):
    lines = spark.createDataFrame([("d", 2, 0, "later", None), ("d", 1, 1, "body | x", None), ("d", 1, 0, "Big", 1), ("d", 3, 0, "  ", None)], "doc_id string, page_number int, pos int, text string, level int")
    cells = spark.createDataFrame([("d", 2, 0, r, c, f" v{r}{c} ") for r in range(3) for c in range(2)] + [("d", 4, 0, 0, 0, "")], "doc_id string, page_number int, table_no int, row int, col int, value string")
    nodes = assemble.page_nodes(lines, cells, max_rows=2)
    assert render.markdown(nodes).first().markdown == "## Page 1\n\n# Big\n\nbody \\| x\n\n## Page 2\n\n<!-- Table truncated: showing first rows of 3 total -->\n| v00 | v01 |\n| --- | --- |\n| v10 | v11 |\n\nlater"
    got = nodes.orderBy("node_id").collect()
    assert [r.node_id for r in got] == list(range(6)) and [r.section for r in got] == [0, 1, 1, 2, 2, 2] and got[2].path == ["Big"] and got[4].page == 2


def test_transcripts(spark):
    segs = spark.createDataFrame([("d", 0, "hello", 0.0, 1.0, "A"), ("d", 1, "again", 40.0, 41.0, None), ("quiet", 0, " ", 0.0, 1.0, None)], "doc_id string, seg_no int, text string, start double, end double, speaker string")
    titles = spark.createDataFrame([("d", "Talk")], "doc_id string, title string")
    got = {r.doc_id: r.markdown for r in render.markdown(assemble.transcript_nodes(segs, titles)).collect()}
    assert got == {"d": "# Talk\n\n**[00:00] A:** hello\n\n## [00:40]\n\n**[00:40]:** again", "quiet": "# quiet\n\nNo speech was detected."}


def test_warnings(spark):
    out = Outline("x")
    out.warn("table_truncated", "m", count=3)
    out.notes.append("n")
    docs, _ = frames(spark, out)
    pages = spark.createDataFrame([("0", 1, "��")], "doc_id string, page_number int, text string")
    more = assemble.corruption_warnings(paragraphs.corrupt_pages(pages))
    pairs = assemble.continuation_warnings(tables.continued_tables(spark.createDataFrame([("0", 1, 0, 2), ("0", 2, 0, 2), ("0", 3, 0, 2)], "doc_id string, page int, table_no int, ncols int")))
    got = sorted((r.channel, r.type or "", r.message, r.pages, r["count"]) for r in assemble.warnings_of(docs, more, pairs).collect())
    assert [(c, t, p, n) for c, t, _, p, n in got] == [("note", "", None, None), ("operator", "cross_page_table", [1, 2, 3], 2), ("operator", "font_encoding_unsupported", [1], None), ("warning", "table_truncated", None, 3)]
    scanned = paragraphs.scanned_documents(pages)
    assert assemble.scanned_warnings(scanned).first().type == "scanned_content"


def test_pools_and_stages(spark):
    with service.scheduler_pool(spark, "batch"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "batch"
    assert [r.pct for r in service.stage_table(spark).collect()] == [2, 10, 85, 90, 95, 100]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.html").write_text("<h1>A</h1>")
    main([str(tmp_path / "in.html"), str(tmp_path / "out"), "--output", "html"])
    assert spark.read.parquet(str(tmp_path / "out")).first().html == "<h1>A</h1>"


def test_long_documents_cost_no_more_than_their_length(spark):
    lines = spark.range(30_000).selectExpr("'d' as doc_id", "cast(id div 10 as int) as page_number", "id as pos", "repeat('x', 1000) as text")
    nodes = assemble.page_nodes(lines)
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # what gives the lines runs once
    began = time.monotonic()
    got = render.markdown(nodes).selectExpr("length(markdown) as n", "substring(markdown, 1, 17) as begins", "md5(markdown) as md5").first()
    whole = "\n\n".join(f"## Page {p}" + ("\n\n" + "x" * 1000) * 10 for p in range(3000))
    assert (got.n, got.begins, got.md5) == (len(whole), "## Page 0\n\nxxxxxx", hashlib.md5(whole.encode()).hexdigest())
    assert time.monotonic() - began < 30  # text put behind text again and again would copy 450 GB

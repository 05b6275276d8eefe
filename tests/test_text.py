"""Scalar functions."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import json as J
from folioflow.functions import text as T


def values(spark, fn, given, kind="string"):
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_page_numbers(spark):
    assert values(spark, T.is_page_number, ["5", " 12 ", "| 6", "Page 5", "5 of 20", "- 5 -", "|7|", "-page  12", "3of 4", "\t9"]) == [True] * 10
    assert values(spark, T.is_page_number, ["Revenue: 500", "Stage 2", "Total: 42", "5 apples", "", "Page", "Page5", "Page 5 -", "PAGE 5", "5 of", "5 of20", "1 of 2 of 3", "--", "5 6", "of 3"]) == [False] * 15


def test_tokens(spark):
    assert values(spark, T.word_count, ["a b  c", "", None, " x y ", " a"]) == [3, 0, 0, 2, 1]
    assert values(spark, T.token_estimate, ["", "abc", "abcd", "é" * 9]) == [0, 0, 1, 2]


def test_lines(spark):
    given = ["a\nb", "a\r\nb\n", "", "\n", "a b\x0cc", "a\n\nb"]
    assert values(spark, T.lines, given) == [g.splitlines() for g in given]


def test_pdf_dates(spark):
    given = ["D:20240115103000+05'30'", "D:20240115103000Z", "20240115103000", "D:20240115103000-08'00'", None, "", "garbage", "D:202401151030", "D:20240115103005+0530", "D:202401151030-08:00", "D:20240115103000+5", "2024-01-15T10:30"]
    assert values(spark, T.pdf_date, given) == ["2024-01-15T10:30:00+05:30", "2024-01-15T10:30:00+00:00", "2024-01-15T10:30:00+00:00", "2024-01-15T10:30:00-08:00", None, None, None, "2024-01-15T10:30:00+00:00", "2024-01-15T10:30:05+05:30", "2024-01-15T10:30:00-08:00", "2024-01-15T10:30:00+00:00", None]


def test_quoting(spark):
    given = ["plain", "it's", 'say "hi"', "both ' and \"", "a\\b", "a\nb"]
    assert values(spark, T.quoted, given) == [repr(g) for g in given]


def test_clock(spark):
    assert values(spark, T.clock, [0.0, 59.9, 61.0, 3600.0, 6000.5], "double") == ["00:00", "00:59", "01:01", "60:00", "100:00"]


def test_small_strings(spark):
    assert values(spark, T.keywords, ["a, b;c,,", ""]) == [["a", "b", "c"], []]
    assert values(spark, T.local_name, ["tns:Name", "Name", "a:b:c"]) == ["Name", "Name", "b:c"]
    assert values(spark, T.strip_fence, ['```json\n{"a":1}\n```', ' {"a":1} ', "```\nx\n```", "```json {}```", "``` a", "```"]) == ['{"a":1}', '{"a":1}', "x", "{}", "``` a", "```"]
    assert values(spark, T.xml_sanitised, ['<?xml version="1.0"?><a xmlns:x="u" xmlns=\'v\' b="c">R&D &amp; &#10; &#xAf; &x; &#xg;</a>', "plain"]) == ['<a b="c">R&amp;D &amp; &#10; &#xAf; &amp;x; &amp;#xg;</a>', "plain"]
    assert values(spark, T.escape_html, ["<a href=\"x\">'&'</a>"]) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"]
    file_id = "1AbCdEfGhIjKlMnOpQrStUvWxYz_-012345"
    assert values(spark, T.drive_file_id, [f"https://docs.example.com/document/d/{file_id}/edit", f"https://x.example.com/open?id={file_id}", file_id, "short", f"https://x.example.com/d/short/d/{file_id}", f"{file_id} x"]) == [file_id] * 3 + [None, file_id, None]
    assert values(spark, T.media_type, ["a/b.JPG", "x.png", "x.webp", "x"]) == ["image/jpeg", "image/png", "image/webp", "image/png"]
    assert values(spark, T.sql_type, [" decimal (10,2) "]) == ["DECIMAL (10,2)"]
    assert values(spark, T.sql_comments_stripped, ["a -- x\nb /* y\n */ c"]) == ["a  \nb   c"]
    assert values(spark, T.percent, [0.5, 0.125, 0.785], "double") == ["50%", "12%", "78%"]


def test_data_urls(spark):
    import base64

    frame = spark.createDataFrame([("a.JPG", bytes(range(200)))], "p string, c binary")
    assert frame.select(T.data_url(F.col("p"), F.col("c")).alias("u")).first().u.replace("\r\n", "") == "data:image/jpeg;base64," + base64.b64encode(bytes(range(200))).decode()


def test_pipe_tables(spark):
    assert values(spark, T.gfm_rows, ["| a | b |\n| --- | :-: |\n| 1 | 2 |", "no table", "| alone |"]) == [[["a", "b"], ["1", "2"]], [], []]


@pytest.mark.parametrize(
    "text, kind",
    [
        ('{"$schema": "x"}', "schema"), ('{"definitions": {}}', "schema"), ('{"properties": {}, "type": "object"}', "schema"), ('{"a": 1, "b": null, "c": "x"}', "flat_object"),
        ('{"a": {"b": 1}}', "code"), ("{}", "code"), ('[{"a": 1}, {"b": 2}]', "array_dump"), ("[1, 2]", "code"), ("[]", "code"), ("3", "code"), ("{", "invalid"),
    ],
)
def test_json_kinds(spark, text, kind):
    assert values(spark, J.json_kind, [text]) == [kind]

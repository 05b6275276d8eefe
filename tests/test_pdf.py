"""PDF files, written by hand."""

import zlib

import pytest

from folioflow.operators import paragraphs
from folioflow.sources import pdf
from folioflow.sources.registry import parse_sources


def made(pages, fonts=b"<</F1 <</Type/Font/Subtype/Type1/BaseFont/Helvetica>>>>", info=b"", packed=False, more=b"", tail=b""):
    """A file of content streams."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[" + kids + b"]/Count %d/MediaBox[0 0 600 800]/Resources<</Font " % len(pages) + fonts + b">>>> endobj\n"
    for i, body in enumerate(pages):
        data = zlib.compress(body) if packed else body
        out += b"%d 0 obj <</Type/Page/Parent 2 0 R/Contents %d 0 R>> endobj\n%d 0 obj <</Length %d%s>> stream\n" % (10 + 2 * i, 11 + 2 * i, 11 + 2 * i, len(data), b"/Filter/FlateDecode" if packed else b"")
        out += data + b"\nendstream endobj\n"
    return out + more + b"3 0 obj <<" + info + b">> endobj\ntrailer <</Root 1 0 R/Info 3 0 R" + tail + b">>"


PAGE = rb"""BT /F1 24 Tf 72 700 Td (A Title) Tj ET
BT /F1 12 Tf 14 TL 72 660 Td (First line of \(the\) text, with \351 and) Tj T* [(Sec) -20 (ond) -600 (line here)] TJ 0 -14 Td (third line of it) Tj ET
BT /F1 12 Tf 72 780 Td (Running head) Tj ET BT /F1 12 Tf 300 40 Td (Page 3) Tj ET BT /F1 12 Tf 72 600 Td (- 7 -) Tj ET"""


def shown(out):
    return [(n["type"], n["level"], n["runs"][0]["text"]) for n in out.nodes]


@pytest.mark.parametrize("packed", [False, True])
def test_pages(packed):
    out = pdf.parse(made([PAGE, b"", PAGE.replace(b"A Title", b"Next")], info=rb"/Title(T \(x\))/Subject<feff00e9>/Keywords(a; b,c)/CreationDate(D:20240115103000+05'30')", packed=packed), {})
    text = [("paragraph", None, "First line of (the) text, with é and"), ("paragraph", None, "Second line here"), ("paragraph", None, "third line of it")]
    assert shown(out) == [("heading", 2, "Page 1"), ("heading", 1, "A Title"), *text, ("heading", 2, "Page 3"), ("heading", 1, "Next"), *text]
    meta = out.row()["metadata"]
    assert (meta["title"], meta["subject"], meta["description"], meta["keywords"], meta["created_at"], meta["page_count"], meta["word_count"]) == ("T (x)", "é", "é", ["a", "b", "c"], "2024-01-15T10:30:00+05:30", 3, 30)
    assert out.outcome == "success" and [n["page"] for n in out.nodes][0] == 1


def test_composite_fonts_and_forms():
    table = b"beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar 1 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    more = b"5 0 obj <</Length %d>> stream\n%s\nendstream endobj\n6 0 obj <</Subtype/Form/Matrix[1 0 0 1 0 -20]/Length 60>> stream\nBT /F1 12 Tf 72 500 Td <00010020> Tj ET\nendstream endobj\n" % (len(table), table)
    fonts = b"<</F1 <</Subtype/Type0/BaseFont/ABC+X/ToUnicode 5 0 R/DescendantFonts[<</DW 600/W[1[500] 16 18 400]>>]>>>>/XObject <</Fm 6 0 R>>"
    body = b"BT /F1 12 Tf 72 600 Td <000100020010001100120021> Tj ET q /Fm Do Q BT /F1 12 Tf 72 400 Td <00990098> Tj ET"
    out = pdf.parse(made([body], fonts, more=more), {})
    assert [t for _, _, t in shown(out)] == ["Page 1", "H\U0001f600abcy", "Hx", "��"]
    assert [w["type"] for w in out.warnings] == ["font_encoding_unsupported", "scanned_content"] and out.outcome == "ocr_required"


def test_encodings():
    fonts = b"<</F1 <</Subtype/Type1/BaseFont/T/Encoding<</Differences[1/A/eacute 5/fi/uni20AC/unknownname]>>>>>>"
    out = pdf.parse(made([rb"BT /F1 12 Tf 72 600 Td (\001\002 \005\006 word and more words) Tj ET"], fonts), {})
    assert shown(out)[1][2] == "Aé fi€ word and more words"


def test_objects_in_streams():
    inner = b"1 0 2 36 4 120 <</Type/Catalog/Pages 2 0 R      >> "
    parts = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[4 0 R]/MediaBox[0 0 600 800]/Resources<</Font<</F1 <</Subtype/Type1/BaseFont/H>>>>>>>>"), (4, b"<</Type/Page/Contents 9 0 R>>")]
    body, head = b"", b""
    for n, p in parts:
        head += b"%d %d " % (n, len(body))
        body += p + b" "
    inner = zlib.compress(head + body)
    text = b"BT /F1 12 Tf 72 600 Td (Five words are in here) Tj ET"
    data = b"%%PDF-1.5\n8 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>> stream\n" % (len(head), len(inner)) + inner + b"\nendstream endobj\n9 0 obj <</Length 999>> stream\n" + text + b"\nendstream endobj\n7 0 obj <</Type/XRef/Root 1 0 R/Length 0>> stream\n\nendstream endobj"
    assert [t for _, _, t in shown(pdf.parse(data, {}))] == ["Page 1", "Five words are in here"]


def test_bad_files(spark):
    rows = [("a", "a", ".pdf", b"not one"), ("b", "b", ".pdf", made([PAGE], tail=b"/Encrypt 3 0 R")), ("c", "c", ".pdf", made([])), ("d", "d", ".pdf", made([b"BT Tf ( ] >> Tj /X Do 1 cm Q"])), ("e", "e", ".pdf", None), ("f", "f", ".pdf", made([PAGE]))]
    got = {r.doc_id: r for r in parse_sources(spark.createDataFrame(rows, "doc_id string, source string, ext string, content binary")).collect()}
    assert [got[k].outcome for k in "abcdef"] == ["parse_error", "parse_error", "success", "ocr_required", "parse_error", "success"]
    assert "encrypted" in got["b"].notes[0] and got["c"].nodes == []


def test_chars_feed_the_operators(spark):
    turned = b"BT /F1 10 Tf 0 1 -1 0 300 300 Tm (daeh) Tj ET"
    sources = spark.createDataFrame([("d", made([PAGE + turned])), ("x", b"bad")], "doc_id string, content binary")
    chars = pdf.pdf_chars(sources)
    assert "".join(r.text for r in chars.where("size > 20").orderBy("pos").collect()) == "A Title"
    fonts = {r["size"] for r in paragraphs.line_fonts(chars).collect()}
    assert {24.0, 12.0} <= fonts and [(r.wrong, r.right) for r in paragraphs.rotated_runs(chars).collect()] == [("daeh", "head")]


def test_dates_and_page_numbers():
    given = ["D:20240115103000+05'30'", "D:20240115103000Z", "20240115103000", "D:20240115103000-08'00'", None, "", "garbage", "D:202401151030"]
    assert [pdf.date_of(g) for g in given] == ["2024-01-15T10:30:00+05:30", "2024-01-15T10:30:00+00:00", "2024-01-15T10:30:00+00:00", "2024-01-15T10:30:00-08:00", None, None, None, "2024-01-15T10:30:00+00:00"]
    assert all(map(pdf.is_page_number, ["5", "| 6", "Page 5", "5 of 20", "- 5 -"])) and not any(map(pdf.is_page_number, ["Stage 2", "Total: 42", "5 apples", "", "Page 5 -"]))


def test_parts_are_dealt_out_and_objects_read_once(spark, sf_dir, monkeypatch):
    from folioflow.plans import catalog

    assert catalog.queries()["pdf_markdown"](spark, sf_dir).rdd.getNumPartitions() == 8  # one file of one group of rows
    reads, fonts = [], []
    scan, font = pdf.Scanner.__init__, pdf.Font.__init__
    monkeypatch.setattr(pdf.Scanner, "__init__", lambda self, data, at=0: (reads.append(at), scan(self, data, at))[1])
    monkeypatch.setattr(pdf.Font, "__init__", lambda self, document, own: (fonts.append(own), font(self, document, own))[1])
    file = made([PAGE, PAGE], fonts=b"<</F1 5 0 R>>", more=b"5 0 obj <</Type/Font/Subtype/Type1/BaseFont/Helvetica>> endobj\n")
    assert [t for _, _, t in shown(pdf.parse(file, {}))][1:3] == ["A Title", "First line of (the) text, with é and"]
    assert len(fonts) == 1 and max(map(reads.count, set(reads) - {0})) == 1

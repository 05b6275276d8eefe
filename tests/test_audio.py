"""Recordings and shared documents."""

import io
import json
import wave

import numpy as np

from folioflow.plans.catalog_formats import workbook
from folioflow.plans.convert import convert_sources
from folioflow.sources import audio, external


def recording(x, rate=1000, width=2):
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((x * 30000).astype("<i2").tobytes() if width == 2 else (x * 100 + 128).astype(np.uint8).tobytes())
    return held.getvalue()


def test_recordings_are_cut_where_they_are_quiet():
    loud = np.random.default_rng(1).uniform(-1, 1, size=25_000)
    loud[8500:8700] = loud[17_000:17_300] = 0
    for width in (1, 2):
        parts = audio.pieces(recording(loud, width=width), longest=10.0, searched=3.0)
        assert [round(o, 1) for o, _ in parts] == [0.0, 8.6, 17.2]
        assert sum(audio.probe(p)["seconds"] for _, p in parts) == 25.0
    assert audio.pieces(recording(loud), longest=100.0) == [(0.0, recording(loud))]
    heard = audio.in_pieces(lambda piece: [("x", 0.0, audio.probe(piece)["seconds"])], longest=10.0)(recording(np.zeros(25_000)))
    assert heard[0][1] == 0.0 and heard[-1][2] == 25.0 and all(abs(a[2] - b[1]) < 1e-9 for a, b in zip(heard, heard[1:], strict=False))


def test_probes(spark):
    rows = spark.createDataFrame([("a", recording(np.zeros(2000))), ("b", b"no"), ("c", None)], "doc_id string, content binary")
    got = {r.doc_id: r for r in audio.probed(rows).collect()}
    assert (got["a"].seconds, got["a"].hertz, got["a"].channels, got["a"].kbps, got["a"].error) == (2.0, 1000, 1, 16.0, None)
    assert got["b"].error and got["c"].error and got["b"].seconds is None


def test_shared_documents_reach_their_parsers(spark):
    file_id = "1AbCdEfGhIjKlMnOpQrStUvWxYz_-012345"
    book = workbook({"S": '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c></row></sheetData>'})
    note = json.dumps({"url": f"https://docs.example.com/spreadsheets/d/{file_id}/edit"}).encode()
    rows = [("a", "x.gsheet", ".gsheet", note), ("b", f"https://docs.example.com/spreadsheets/d/{file_id}", "", None), ("c", "x.gdoc", ".gdoc", b"{}"), ("d", "x.csv", ".csv", b"p,q\r\n1,2")]
    sources = spark.createDataFrame(rows, "doc_id string, source string, ext string, content binary")
    got = {r.doc_id: r for r in convert_sources(external.shared_sources(sources, lambda i: book if i == file_id else b"")).collect()}
    assert "| a |" in got["a"].markdown and "| a |" in got["b"].markdown and "| 1 | 2 |" in got["d"].markdown
    assert got["c"].outcome == "parse_error" and got["c"].notes == ["no file id"] and got["a"].source == "x.gsheet"

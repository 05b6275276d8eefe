"""Every registered query against its SQL, on the smallest tables."""

import re

import duckdb
import pandas as pd
import pytest

from folioflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_corruption_of_every_document(spark, sf_dir):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in catalog.queries()["encoding_corruption"](spark, sf_dir).collect()} == docs


@pytest.mark.parametrize("name", ["chunks_pages", "page_json", "page_markdown", "page_sections", "page_html", "page_main_content"])
def test_references_without_their_end_stay_text(spark, sf_dir, tmp_path, name):
    """Headings are cut at a length, and so within a reference."""
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").head(8)
    cut = ["a &amp", "b &am", "c &lt", "d &#x27", "e &#x2", "f &copy=1 &amp;", "g &ampx; &", "h &#39"]
    pages["html"] = [re.sub(r"<h1>[^<]*", f"<h1>{c}", h).replace("</p>", f" {c}</p>") for c, h in zip(cut, pages["html"], strict=True)]
    pages.to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert rows(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["page_json", "page_markdown", "page_sections", "page_html"])
def test_references_without_their_end_in_menus_and_titles(spark, sf_dir, tmp_path, name):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").head(8)
    cut = ["a &amp", "b &am", "c &lt", "d &#x27", "e &#x2", "f &copy=1 &amp;", "g &ampx; &", "h &#39"]
    pages["html"] = [re.sub(r"(<title>|<li><a href=\"[^\"]*\">)[^<]*", lambda m, c=c: m[1] + c, h) for c, h in zip(cut, pages["html"], strict=True)]
    pages.to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert rows(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["page_json", "page_markdown", "page_sections", "page_html", "page_main_content"])
def test_private_characters_are_no_ampersands(spark, tmp_path, name):
    """Icons are often references to the first private characters, beside which a text may hold loose ampersands."""
    page = "<nav><ul><li><a href='/x'>m</a></li></ul></nav><article><h1>h \ue002 &amp</h1><p>a &#xE000; &#57345; &#xe003;&#xfdd0; b</p></article>"
    pd.DataFrame({"page_id": [1], "url": ["https://example.com/"], "html": [page]}).to_parquet(tmp_path / "pages.parquet")
    got = " ".join(str(v) for r in catalog.queries()[name](spark, str(tmp_path)).collect() for v in r)
    assert "h \ue002 &amp" in got and "a \ue000 \ue001 \ue003 b" in got

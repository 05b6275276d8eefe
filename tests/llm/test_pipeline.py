"""The pipeline against its operators, stage by stage."""

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import decontamination, language_id, packing, simhash
from folioflow.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_shrinking(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.count(), *(s.count() for s in stages[:-1])]
    assert all(s.columns == docs.columns for s in stages[:-1]) and counts == sorted(counts, reverse=True) and counts[-1] > 0
    for before, after in zip([docs, *stages], stages[:-1], strict=False):
        assert after.exceptAll(before).count() == 0


def test_decisions_took_effect(spark, sf_dir, stages):
    assert all(language_id.has_letter(r.text) for r in stages[0].collect())
    groups = simhash.group_report(stages[1]).collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({r.component_id for r in groups})
    report = decontamination.overlap_report(stages[2], table(spark, sf_dir, "benchmark"))
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in report.where("not contaminated").collect())


def test_packed_tokens(spark, sf_dir, stages):
    tokenizer = packing.WordTokenizer(open(packing.vocabulary_path(), encoding="utf-8").read()).tokenizer
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in stages[3].collect()}
    got = {}
    for r in stages[4].orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_run_gives_the_same(spark, sf_dir, stages):
    cols = ["doc_id", "start", "length", "doc_tokens"]
    a, b = corpus_pipeline.run(spark, sf_dir).select(cols), stages[4].select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

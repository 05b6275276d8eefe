"""A corpus pipeline: five stages, each on all rows that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of ``docs``.
"""

from __future__ import annotations

from folioflow.llm import decontamination, language_id, packing, quality_model, simhash
from folioflow.llm.common import cut_lineage, table


def language_stage(spark, docs, sf_dir):
    """Documents whose language can't be told go."""
    model = language_id.fit(language_id.learnable(docs))
    return language_id.keep_identified(docs, model)


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    labels = quality_model.learnable(table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, quality_model.fit(docs, labels))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that a benchmark contaminates go."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Token sequences of what is left: a row per piece, with its ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the classifiers, the fingerprints or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``; what each stage keeps is checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

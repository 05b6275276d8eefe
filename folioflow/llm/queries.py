"""The registered queries of the corpus operators, and the SQL that checks those it can express."""

from __future__ import annotations

from folioflow.llm import decontamination, html_extract, language_id, lm_scoring, packing, quality_model, quality_rules, sharding, simhash, url_filter
from folioflow.llm.common import table


def op1_language_id(spark, sf_dir):
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality_model.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark, sf_dir):
    return decontamination.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark, sf_dir):
    return packing.pack_report(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.group_report(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.url_report(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark, sf_dir):
    return html_extract.extraction_report(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.rules_report(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    own = (op1_language_id, op2_quality_classifier, op3_decontamination, op4_packing, op5_sharding, op6_simhash, op7_url_filter, op8_html_extraction, op9_quality_rules, op10_lm_scoring)
    return {f.__name__: f for f in own}


def oracle_sql():
    return {"op3_decontamination": decontamination.REPORT_SQL, "op8_html_extraction": html_extract.REPORT_SQL, "op9_quality_rules": quality_rules.REPORT_SQL}

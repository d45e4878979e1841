"""The queries opN_<name> and the SQL of those that SQL can express."""

from __future__ import annotations

from chartloom.llm import conversations, decontaminate, fill_in_middle, licenses, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_sampling, simhash, substring_dedup, toxicity, url_filter
from chartloom.llm.base import table


def op1_suffix_array_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filters(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_sampling.encode(table(spark, sf_dir, "documents"), restore=True)


def op10_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op13_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_quality_classifier, op3_url_filters, op4_toxicity, op5_decontamination, op6_quality_rules, op7_simhash, op8_pii, op9_sentencepiece, op10_secret_scan, op11_conversation_repair, op12_fill_in_middle, op13_license_scan)}
ORACLES = {"op1_suffix_array_dedup": substring_dedup.ORACLE, "op3_url_filters": url_filter.oracle(), "op5_decontamination": decontaminate.ORACLE, "op11_conversation_repair": conversations.oracle(), "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_license_scan": licenses.oracle()}

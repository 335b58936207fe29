"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import html_text, jaccard, language, licenses, mixing, neighbours, ordinal, packing, rules, secrets
from vicinal.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_languages(spark, docs, language.train_language_model(docs))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = ordinal.rate_documents(spark, docs, ordinal.train_quality(docs, table(spark, sf_dir, "labels")))
    return rated.selectExpr("doc_id", "quality_expected AS expected_grade", "quality_top AS top_probability", "quality_kept AS kept")


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op7_pack_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), cache_words=500_000)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.train_rules(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_html_text": op2_html_text,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_cross_polytope": op5_cross_polytope,
        "op6_mix_sources": op6_mix_sources,
        "op7_pack_best_two_fit": op7_pack_best_two_fit,
        "op8_quality_rules": op8_quality_rules,
        "op9_license_scan": op9_license_scan,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": mixing.ORACLE_OP6, "op9_license_scan": licenses.oracle_op9()}

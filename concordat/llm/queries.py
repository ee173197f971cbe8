"""Queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import (
    decontamination,
    fuzzy_fingerprints,
    html_main,
    language_id,
    lexical_search,
    mixing,
    ngram_jaccard,
    pseudonyms,
    secret_scan,
    simhash_anchors,
    source_divergence,
    sql,
    tool_calls,
    toxicity,
)
from concordat.sources.tables import load


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(load(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_fingerprints.neighbours(load(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(load(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(load(spark, sf_dir, "documents"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.report(load(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.report(load(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(load(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(load(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.report(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_fingerprints": op4_fingerprints,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_language": op6_language,
    "op7_tool_calls": op7_tool_calls,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_ngram_join": op10_ngram_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_simhash": op13_simhash,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)

"""Queries over the test tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import op1_pii, op2_quality, op3_chat, op4_mixing, op5_chunks, op6_toxicity, op7_tiff, op8_jaccard, op9_language, op10_decontaminate, op11_periodic, op12_graph_search, op13_spelling
from loomgraph.llm.common import table


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.report(table(spark, sf_dir, "documents"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_chat.report(table(spark, sf_dir, "conversations"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.report(table(spark, sf_dir, "documents"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_chunks.report(table(spark, sf_dir, "documents"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_tiff.report(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_jaccard.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language.report(table(spark, sf_dir, "documents"))


def op10_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return op10_decontaminate.report(found)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_periodic.report(table(spark, sf_dir, "documents"))


def op12_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_graph_search.report(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii_spans, op2_quality_ranking, op3_chat_formatting, op4_source_mixing, op5_chunk_dedup,
        op6_toxicity_chain, op7_tiff_pages, op8_jaccard_join, op9_language_id, op10_winnow_decontamination,
        op11_periodic_runs, op12_graph_neighbours, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_pii_spans": op1_pii.SQL, "op3_chat_formatting": op3_chat.SQL, "op8_jaccard_join": op8_jaccard.SQL, "op10_winnow_decontamination": op10_decontaminate.SQL}

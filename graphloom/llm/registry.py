"""The queries of the training-data operators: each applies one operator to its whole table and shapes the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.conversation_trie import OP13_SQL, conversation_trie
from graphloom.llm.extraction import extract_main_text
from graphloom.llm.fill_in_middle import OP12_SQL, op12_columns
from graphloom.llm.jaccard_join import OP11_SQL, jaccard_components
from graphloom.llm.language import identify_language
from graphloom.llm.line_dedup import OP2_SQL, op2_columns
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.nearest import nearest_neighbours
from graphloom.llm.packing import pack
from graphloom.llm.pieces import op3_columns
from graphloom.llm.quality_classifier import quality_scores
from graphloom.llm.quality_rules import quality_rules
from graphloom.llm.shared import table
from graphloom.llm.toxicity import toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_columns(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_columns(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_columns(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_sentencepiece, op4_near_dedup, op5_quality_rules, op6_quality_classifier, op7_html_extraction, op8_packing, op9_nearest_neighbours, op10_toxicity, op11_jaccard_join, op12_fill_in_middle, op13_conversation_trie)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op11_jaccard_join": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_conversation_trie": OP13_SQL}

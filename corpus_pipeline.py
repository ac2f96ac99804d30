"""From raw documents to packed training sequences, in five stages that each work on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import quality_rules
from graphloom.llm.shared import settle, table
from graphloom.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts stay out of the search: they are joined to the verdicts by doc_id and a hash of the text, which equal rows share."""
    row = F.xxhash64("text")
    gone = near_duplicates(docs.withColumn("row", row), carry=("row",)).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_row"]), "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]

#: Outlier estimates, a trained classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs

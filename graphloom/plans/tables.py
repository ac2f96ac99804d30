"""The test tables, and the views on them that several queries share: documents as source files, the order tables as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: file_name by id and language, text."""
    ext = F.when(F.col("lang") == "en", ".sql").when(F.col("lang") == "fr", ".CBL").when(F.col("lang") == "de", ".dtsx").otherwise(".txt")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id"), ext).alias("file_name"), "source", "text")


SOURCE_FILES_SQL = "(SELECT doc_id, 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.sql' WHEN 'fr' THEN '.CBL' WHEN 'de' THEN '.dtsx' ELSE '.txt' END AS file_name, source, text FROM documents)"


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities of files, one file a brand."""
    ext = F.when(F.length("p_brand") % 2 == 0, ".sql").otherwise(".dtsx")
    return table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(":"), "p_name").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", ext).alias("source_file"))


PART_ENTITIES_SQL = "(SELECT p_type || ':' || p_name AS id, p_name AS name, p_brand || CASE WHEN length(p_brand) % 2 = 0 THEN '.sql' ELSE '.dtsx' END AS source_file FROM part)"

_NODES = (("region", "REGION", "r_regionkey", "r_name"), ("nation", "NATION", "n_nationkey", "n_name"), ("customer", "CUSTOMER", "c_custkey", "c_name"), ("supplier", "SUPPLIER", "s_suppkey", "s_name"), ("part", "PART", "p_partkey", "p_name"), ("orders", "ORDER", "o_orderkey", "o_orderstatus"))
_EDGES = (("nation", "NATION", "n_nationkey", "BELONGS_TO", "REGION", "n_regionkey"), ("customer", "CUSTOMER", "c_custkey", "BELONGS_TO", "NATION", "c_nationkey"), ("supplier", "SUPPLIER", "s_suppkey", "BELONGS_TO", "NATION", "s_nationkey"), ("orders", "ORDER", "o_orderkey", "READS_FROM", "CUSTOMER", "o_custkey"), ("lineitem", "ORDER", "l_orderkey", "USES", "PART", "l_partkey"), ("lineitem", "PART", "l_partkey", "FEEDS_INTO", "SUPPLIER", "l_suppkey"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{label}:"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), F.lit(t).alias("source_file")) for t, label, key, name in _NODES]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """The edges of the graph; unless each is asked for ``once``, as often as the rows that they are made of, with nothing shuffled."""
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{a}:"), F.col(ka)).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(f"{b}:"), F.col(kb)).alias("dst")) for t, a, ka, kind, b, kb in _EDGES]
    return reduce(DataFrame.unionByName, [p.distinct() for p in parts] if once else parts)


NODES_SQL = "(" + " UNION ALL ".join(f"SELECT '{label}:' || {key} AS id, '{label}' AS label, {name} AS name, '{t}' AS source_file FROM {t}" for t, label, key, name in _NODES) + ")"
EDGES_SQL = "(" + " UNION ALL ".join(f"SELECT DISTINCT '{a}:' || {ka} AS src, '{kind}' AS type, '{b}:' || {kb} AS dst FROM {t}" for t, a, ka, kind, b, kb in _EDGES) + ")"
SYMMETRIC_SQL = f'(SELECT src AS "at", dst AS "to", src, type, dst FROM {EDGES_SQL} UNION ALL SELECT dst, src, src, type, dst FROM {EDGES_SQL} WHERE src <> dst)'

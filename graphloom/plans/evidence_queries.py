"""Queries of evidence under budgets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import evidence
from graphloom.plans.tables import table

BUDGET = 2000


def evidence_heads(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language and source: how many, and how the first ten begin."""
    found = evidence.heads(table(spark, d, "documents"), ["lang", "source"], "text", "doc_id")
    return found.withColumn("head", F.array_join(F.transform("head", lambda x: F.sha1(x.cast("binary"))), ","))


EVIDENCE_HEADS = """SELECT lang, source, count(*) AS total, string_agg(sha1(substr(coalesce(text, ''), 1, 300)), ',' ORDER BY n) FILTER (WHERE n <= 10) AS head, count(*) > 10 AS more
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) GROUP BY lang, source"""


def packed_context(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each nation by balance, packed into a context of so many characters."""
    said = F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    rows = table(spark, d, "customer").select("c_nationkey", (-F.col("c_acctbal")).alias("rank"), "c_custkey", said.alias("text"))
    return evidence.packed(rows, "c_nationkey", "text", "rank", "c_custkey", budget=200)


PACKED_CONTEXT = """WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal, concat_ws(' ', c_name, c_mktsegment, c_custkey) AS t FROM customer),
a AS (SELECT c_nationkey, string_agg(t, chr(10) || chr(10) ORDER BY c_acctbal DESC, c_custkey) AS whole FROM p GROUP BY 1),
b AS (SELECT c_nationkey, sum(length(t) + 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) - length(t) - 2 AS begins FROM p)
SELECT a.c_nationkey, substr(any_value(whole), 1, 200) AS context, CAST(count(*) FILTER (WHERE begins < 200) AS INTEGER) AS items, length(any_value(whole)) <= 200 AS whole FROM a JOIN b ON a.c_nationkey = b.c_nationkey GROUP BY 1"""


def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A question a part: its orders as graph evidence, documents of its size as vector evidence."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    by = W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    graph = lines.withColumn("rank", F.row_number().over(by)).select("l_partkey", "rank", F.concat(F.lit("ORDER:"), "l_orderkey", F.lit(" uses PART:"), "l_partkey").alias("text"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 50).alias("of"))
    texts = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("of"), "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("file_name"), (F.col("doc_id") % 7 / 8).alias("score"), "text")
    ranked = texts.withColumn("rank", F.row_number().over(W.partitionBy("of").orderBy("doc_id"))).filter(F.col("rank") <= evidence.VECTOR_EVIDENCE)
    found = evidence.answer_context(graph, parts.join(ranked, "of").select("l_partkey", "rank", "file_name", "score", "text"), "l_partkey", BUDGET)
    return found.select("l_partkey", F.sha1(F.col("context").cast("binary")).alias("context_sha1"), F.length("context").alias("chars"), "items", "whole")


ANSWER_CONTEXTS = """WITH g AS (SELECT l_partkey, 0 AS kind, n AS rank, t FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n, 'ORDER:' || l_orderkey || ' uses PART:' || l_partkey AS t FROM lineitem) WHERE n <= 15),
r AS (SELECT * FROM (SELECT doc_id % 50 AS grp, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, printf('[doc_%d | score=%.3f]', doc_id, (doc_id % 7) / 8.0) || chr(10) || substr(coalesce(text, ''), 1, 500) AS t FROM documents) WHERE rank <= 8),
e AS (SELECT * FROM g UNION ALL SELECT p_partkey, 1, rank, t FROM part JOIN r ON grp = p_partkey % 50),
b AS (SELECT *, sum(length(t) + 2) OVER (PARTITION BY l_partkey ORDER BY kind, rank ROWS UNBOUNDED PRECEDING) - length(t) - 2 AS begins FROM e),
w AS (SELECT l_partkey, string_agg(t, chr(10) || chr(10) ORDER BY kind, rank) AS whole, count(*) FILTER (WHERE begins < 2000) AS items FROM b GROUP BY 1)
SELECT l_partkey, sha1(substr(whole, 1, 2000)) AS context_sha1, CAST(length(substr(whole, 1, 2000)) AS INTEGER) AS chars, CAST(items AS INTEGER) AS items, length(whole) <= 2000 AS whole FROM w"""

QUERIES = {"evidence_heads": (evidence_heads, EVIDENCE_HEADS), "packed_context": (packed_context, PACKED_CONTEXT), "answer_contexts": (answer_contexts, ANSWER_CONTEXTS)}

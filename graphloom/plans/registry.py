"""The registered queries of the analytics engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import evidence_queries, extract_queries, flow_queries, graph_queries, package_queries, parser_queries, program_queries, scope_queries, search_queries, stream_queries, text_queries, unit_queries

_ALL = text_queries.QUERIES | graph_queries.QUERIES | flow_queries.QUERIES | extract_queries.QUERIES | package_queries.QUERIES | scope_queries.QUERIES | search_queries.QUERIES | program_queries.QUERIES | evidence_queries.QUERIES | unit_queries.QUERIES | stream_queries.QUERIES | parser_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["shared_entities"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}

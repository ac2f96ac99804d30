"""All parsers over all artifacts, and packages read in SQL, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import parsers
from graphloom.plans import artifacts as A
from graphloom.plans import package_queries as K
from graphloom.plans import program_queries as P


def parser_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of scripts, programs of six shapes and packages by parser."""
    scripts = A.scripts(spark, d).withColumn("source_type", F.lit("sql"))
    return parsers.built_in().facts(P._files(spark, d).unionByName(scripts))


def packages_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Facts of packages by kind, read by the table function."""
    parsers.register_sql(spark)
    return spark.sql("SELECT f.file_name, p.kind, count(*) AS n, count(DISTINCT p.name) AS names, max(p.value) AS last_value FROM {files} AS f, LATERAL package_facts(f.text) AS p GROUP BY f.file_name, p.kind", files=A.packages(spark, d))


def _facts_of(source: str, parser: str, kind: str, columns: str) -> str:
    return f"SELECT file_name, '{parser}' AS parser_id, '{kind}' AS kind, {columns} FROM {source}"


_RELATION = "type, source AS name, target"
_PARTS = f"({A.stated(A.PACKAGES, 'source type target', *["'SRC', 'FEEDS_INTO', 'DST'", "'T0', 'PRECEDES', 'T1'", "'T1', 'PRECEDES', 'T2'", "'L' || k, 'PRECEDES', 'L' || k"])}) r"
_PROGRAM = f"({P._by_shape('type name', tuple([*P._ENTITIES, *[f"'PROCEDURE', '{p}'" for p in ps]] for ps in P._PARAGRAPHS))}) e"
_SCRIPT = f"({A.stated(A.SCRIPTS, 'type name', *[f"'TABLE', {t}" for t in K._TABLES], *[f"'COLUMN', {c}" for c in K._COLUMNS])}) e"
_NAMED = "type, name, NULL::VARCHAR AS target"
PARSER_FACTS = " UNION ".join(
    (
        _facts_of(_PROGRAM, "cobol", "ENTITY", _NAMED),
        _facts_of(f"({P._by_shape('source type target', P._LINKS)}) r", "cobol", "RELATION", _RELATION),
        _facts_of(f"({A.stated(A.PACKAGES, 'type name', *P._PARTS)}) e", "ssis", "ENTITY", _NAMED),
        _facts_of(f"({A.stated(A.PACKAGES, 'type name', "'SQL', 'SQL-1'", "'SQL', 'SQL-2'")}) e", "ssis", "TRANSFORMATION", _NAMED),
        _facts_of(_PARTS, "ssis", "RELATION", _RELATION),
        _facts_of(_SCRIPT, "sql", "ENTITY", _NAMED),
        _facts_of(f"{A.SCRIPTS} s", "sql", "TRANSFORMATION", "'CASE' AS type, 'CASE-1' AS name, NULL::VARCHAR AS target"),
        _facts_of(f"{A.SCRIPTS} s", "sql", "RELATION", "'JOINS_WITH' AS type, 'Db1.dbo.tbl_' || k AS name, 'Db2.dbo.ref_' || n AS target"),
    )
)
_KINDS = ("'package', 1::BIGINT, 1::BIGINT, NULL::VARCHAR", "'connection', 1, 1, 'Server=x;'", "'precedence', 3, 0, '0'", "'task', 2, 2, NULL", "'component', 2, 2, NULL", "'end', 2, 2, NULL", "'property', 1, 1, 'select ' || n", "'sql', 1, 1, 'TRUNCATE TABLE s' || k")

QUERIES = {"parser_facts": (parser_facts, PARSER_FACTS), "packages_in_sql": (packages_in_sql, A.stated(A.PACKAGES, "kind n names last_value", *_KINDS))}

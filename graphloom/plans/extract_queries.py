"""Queries of the extractors over artifacts made of table rows, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import cobol, sql, ssis
from graphloom.operators import template
from graphloom.plans import artifacts as A
from graphloom.plans.tables import table
from graphloom.streaming.incremental import event_windows


def _sql(spark: SparkSession, d: str) -> DataFrame:
    return sql.prepared(A.scripts(spark, d))


def _cobol(spark: SparkSession, d: str) -> DataFrame:
    return cobol.program_lines(A.programs(spark, d))


def _ssis(spark: SparkSession, d: str) -> DataFrame:
    return ssis.facts(A.packages(spark, d))


def sql_tables(spark: SparkSession, d: str) -> DataFrame:
    return sql.tables(_sql(spark, d)).drop("pos")


def sql_joins(spark: SparkSession, d: str) -> DataFrame:
    return sql.joins(_sql(spark, d))


def sql_cases(spark: SparkSession, d: str) -> DataFrame:
    return sql.cases(_sql(spark, d)).drop("number")


def sql_business_rules(spark: SparkSession, d: str) -> DataFrame:
    return sql.business_rules(_sql(spark, d))


def sql_where_conditions(spark: SparkSession, d: str) -> DataFrame:
    return sql.where_conditions(_sql(spark, d))


def sql_variables(spark: SparkSession, d: str) -> DataFrame:
    return sql.variables(_sql(spark, d)).unionByName(sql.set_statements(_sql(spark, d)).select("file_name", F.col("variable").alias("name"), F.lit("SET").alias("datatype"), F.col("value").alias("default_value"), "line"))


def sql_column_references(spark: SparkSession, d: str) -> DataFrame:
    return sql.column_references(_sql(spark, d))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    return sql.functions(_sql(spark, d)).select("file_name", F.explode("functions").alias("function"))


def sql_group_by(spark: SparkSession, d: str) -> DataFrame:
    return sql.group_by(_sql(spark, d))


def sql_summary(spark: SparkSession, d: str) -> DataFrame:
    return sql.summary(_sql(spark, d))


def sql_structure(spark: SparkSession, d: str) -> DataFrame:
    return sql.structure(sql.prepared(A.scripts(spark, d, A.STATEMENTS)))


def cobol_divisions(spark: SparkSession, d: str) -> DataFrame:
    return cobol.divisions(_cobol(spark, d))


def cobol_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return cobol.paragraphs(_cobol(spark, d))


def cobol_operations(spark: SparkSession, d: str) -> DataFrame:
    return cobol.operations(_cobol(spark, d))


def cobol_operation_counts(spark: SparkSession, d: str) -> DataFrame:
    return cobol.operation_counts(_cobol(spark, d))


def cobol_files(spark: SparkSession, d: str) -> DataFrame:
    return cobol.files(_cobol(spark, d))


def cobol_records(spark: SparkSession, d: str) -> DataFrame:
    return cobol.records(_cobol(spark, d))


def cobol_variables(spark: SparkSession, d: str) -> DataFrame:
    return cobol.variables(_cobol(spark, d))


def cobol_relationships(spark: SparkSession, d: str) -> DataFrame:
    return cobol.relationships(_cobol(spark, d))


def cobol_section_views(spark: SparkSession, d: str) -> DataFrame:
    return cobol.section_views(_cobol(spark, d))


def ssis_tasks(spark: SparkSession, d: str) -> DataFrame:
    return ssis.tasks(_ssis(spark, d))


def ssis_components(spark: SparkSession, d: str) -> DataFrame:
    return ssis.components(_ssis(spark, d)).withColumn("properties", F.to_json("properties"))


def ssis_flows(spark: SparkSession, d: str) -> DataFrame:
    return ssis.flows(_ssis(spark, d))


def ssis_sql(spark: SparkSession, d: str) -> DataFrame:
    return ssis.sql_statements(_ssis(spark, d))


def ssis_execution_order(spark: SparkSession, d: str) -> DataFrame:
    return ssis.execution_order(_ssis(spark, d))


def structured_extraction(spark: SparkSession, d: str) -> DataFrame:
    return template.extract(template.table_rows(_sql(spark, d)), template.parse("| Database | Schema | Table | Alias | Columns | Joins |"))


def event_window_totals(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(table(spark, d, "events"))


EVENT_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM (SELECT DISTINCT event_id, ts, event_type, value FROM events) GROUP BY 1, 2"

_CASE = "'CASE WHEN t.kind = ' || k || ' THEN ' || {inner} || ' ELSE ''X'' END'".format(inner="'CASE WHEN t.amt > ' || n || ' THEN ''P'' ELSE ''N'' END'")
_INNER = "'CASE WHEN t.amt > ' || n || ' THEN ''P'' ELSE ''N'' END'"
_SEG = "'t.dt > @d AND t.seg = ''' || m || ''''"
SQL_FACTS = {
    "sql_tables": ("source table alias line", "'FROM', 'Db3.dbo.tbl_' || n, 'v', 7", "'FROM', 'Db1.dbo.tbl_' || k, 't', 8", "'JOIN', 'Db2.dbo.ref_' || n, 'u', 9"),
    "sql_joins": ("join_type table alias condition line", "'LEFT JOIN', 'Db2.dbo.ref_' || n, 'u', 't.id = u.a_' || k, 9"),
    "sql_cases": ("target_column expression line nested nesting_level", f"'bucket', {_CASE}, 6, false, 0", f"NULL, {_INNER}, 6, true, 1"),
    "sql_business_rules": ("target_column condition result rule line", "'bucket', 't.kind = ' || k, '(CASE)', 'IF t.kind = ' || k || ' THEN bucket = (CASE)', 6", "NULL, 't.amt > ' || n, '''P''', 'IF t.amt > ' || n || ' THEN CASE_RESULT = ''P''', 6"),
    "sql_where_conditions": ("condition line", "'v.id = t.id', 7", f"{_SEG}, 10"),
    "sql_variables": ("name datatype default_value line", "'@d', 'date', '''2024-01-01''', 2", "'@d', 'SET', CAST(n AS VARCHAR), 3"),
    "sql_column_references": ("alias column reference", "'t', 'id', 't.id'", "'t', 'kind', 't.kind'", "'t', 'amt', 't.amt'", "'u', 'qty', 'u.qty'", "'v', 'n', 'v.n'", "'v', 'id', 'v.id'", "'Db2', 'dbo', 'Db2.dbo'", "'u', 'a_' || k, 'u.a_' || k", "'t', 'dt', 't.dt'", "'t', 'seg', 't.seg'"),
    "sql_functions": ("function", "'MAX'", "'SUM'"),
    "sql_group_by": ("columns line", "'t.id, t.kind, t.amt', 11"),
    "sql_summary": ("raw_joins raw_cases raw_variables variables set_statements tables unique_tables joins cases business_rules where_conditions group_by column_references status", "1, 2, 1, 1::BIGINT, 1::BIGINT, 3::BIGINT, 3::BIGINT, 1::BIGINT, 2::BIGINT, 2::BIGINT, 2::BIGINT, 1::BIGINT, 10::BIGINT, 'PASS'"),
    "sql_structure": ("kind name alias line", "'cte', 'c_' || n, NULL, 1", "'select', NULL, NULL, 1", "'table', 'base_' || k, 'a', 1", "'insert', 'out_' || n, NULL, 2", "'select', NULL, NULL, 2", "'cte_reference', 'c_' || n, 'q', 2", "'derived_table', NULL, 's', 3", "'select', NULL, NULL, 3", "'table', 'side', 'b', 3", "'update', 'fin_' || k, NULL, 4", "'select', NULL, NULL, 5", "'into', '#tmp', NULL, 5", "'cte_reference', 'C_' || n, NULL, 5", "'delete', 'old_' || n, NULL, 6"),
    "structured_extraction": ("Database Schema Table Alias Columns Joins", "'Db3', 'dbo', 'tbl_' || n, 'v', 'id, n', 'UNKNOWN / Not specified'", "'Db1', 'dbo', 'tbl_' || k, 't', 'amt, dt, id, kind, seg', 'UNKNOWN / Not specified'", "'Db2', 'dbo', 'ref_' || n, 'u', 'a_' || k || ', qty', 'LEFT JOIN ON t.id = u.a_' || k"),
}
_HAS = ("'CONTAINS_PARAGRAPH', 'MAIN-STEP'", "'CONTAINS_PARAGRAPH', 'STEP-' || n", "'CONTAINS_RECORD', 'REC-' || k", "'CONTAINS_FIELD', 'POLICY-ID'", "'CONTAINS_FIELD', 'PREMIUM'")
_DOES = ("'READS', 'FILE-A'", "'PERFORMS', 'STEP-' || n", "'OPENS', 'FILE-A'", "'OPENS', 'FILE-B'", "'OPENS', 'FILE-C'", "'CLOSES', 'FILE-A'", "'CLOSES', 'FILE-B'", "'USES_COPYBOOK', 'CPY' || n")
COBOL_FACTS = {
    "cobol_divisions": ("division line", "'IDENTIFICATION', 1", "'ENVIRONMENT', 3", "'DATA', 8", "'PROCEDURE', 19"),
    "cobol_paragraphs": ("paragraph start end", "'MAIN-STEP', 20, 26", "'STEP-' || n, 27, 30"),
    "cobol_operations": ("op text start end", "'open', 'OPEN INPUT FILE-A FILE-B OUTPUT FILE-C', 21, 22", "'perform', 'PERFORM STEP-' || n, 23, 23", "'perform', 'PERFORM UNTIL DONE', 24, 24", "'close', 'CLOSE FILE-A FILE-B.', 25, 26", "'read', 'READ FILE-A', 28, 28", "'add', 'ADD ' || n || ' TO CNT.', 29, 29"),
    "cobol_operation_counts": ("perform read write move open close display if goto add", "2::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT"),
    "cobol_files": ("file line assign", "'FILE-A', 6, 'IN' || k", "'FILE-C', 7, 'OUT' || n", "'FILE-B', 14, NULL"),
    "cobol_records": ("record line fields", "'REC-' || k, 11, ['POLICY-ID', 'PREMIUM']"),
    "cobol_variables": ("level name picture value record line", "'01', 'REC-' || k, NULL, NULL, 'REC-' || k, 11", "'05', 'POLICY-ID', 'X(' || n || ')', NULL, 'REC-' || k, 12", "'05', 'PREMIUM', '9(9)V99', NULL, 'REC-' || k, 13", "'77', 'CNT', '9(4)', CAST(n AS VARCHAR), 'CNT', 17"),
    "cobol_relationships": ("type target", *_HAS, *_DOES),
}
SSIS_FACTS = {
    "ssis_tasks": ("task_no name task_type", "0, 'T0', 'Sql'", "1, 'T1', 'Pipeline'"),
    "ssis_components": ("task_no name task component_class properties", "1, 'SRC', 'T1', 'Source', '{\"SqlCommand\":\"select ' || n || '\"}'", "1, 'DST', 'T1', 'Destination', NULL"),
    "ssis_flows": ("task source target path", "'T1', 'SRC', 'DST', 'O' || k"),
    "ssis_sql": ("task name property_name sql", "'T0', 'T0', 'SqlStatementSource', 'TRUNCATE TABLE s' || k", "'T1', 'SRC', 'SqlCommand', 'select ' || n"),
    "ssis_execution_order": ("task step", "'T0', 0", "'T1', 1", "'T2', 2", "'L' || k, NULL"),
}
ORACLES = {name: A.stated(source, *rows) for source, facts in ((A.SCRIPTS, SQL_FACTS), (A.PROGRAMS, COBOL_FACTS), (A.PACKAGES, SSIS_FACTS)) for name, rows in facts.items()}
ORACLES["structured_extraction"] = ORACLES["structured_extraction"].replace("SELECT file_name, f.*", "SELECT DISTINCT f.*")
_LINES = {"structural": (1, 18), "behavioral": (19, 30)}
_PROGRAM = "replace(replace('" + A.PROGRAM.replace("'", "''") + "', '%1$d', CAST(k AS VARCHAR)), '%2$d', CAST(n AS VARCHAR))"
_VIEWS = [f"SELECT file_name, array_to_string(string_split({_PROGRAM}, chr(10))[{a}:{b}], chr(10)) AS text, '{name}' AS view FROM {A.PROGRAMS}" for name, (a, b) in _LINES.items()]
_RELATED = "list_filter(string_split({p}, chr(10)), lambda x: regexp_matches(x, '^ +(FD|SELECT|COPY|PERFORM|READ|OPEN|CLOSE|ADD) '))".format(p=_PROGRAM)
ORACLES["cobol_section_views"] = " UNION ALL ".join([*_VIEWS, f"SELECT file_name, array_to_string({_RELATED}, chr(10)) AS text, 'relationship' AS view FROM {A.PROGRAMS}"])

_EXTRACTORS = (sql_tables, sql_joins, sql_cases, sql_business_rules, sql_where_conditions, sql_variables, sql_column_references, sql_functions, sql_group_by, sql_summary, sql_structure, cobol_divisions, cobol_paragraphs, cobol_operations, cobol_operation_counts, cobol_files, cobol_records, cobol_variables, cobol_relationships, cobol_section_views, ssis_tasks, ssis_components, ssis_flows, ssis_sql, ssis_execution_order, structured_extraction)
QUERIES = {f.__name__: (f, ORACLES[f.__name__]) for f in _EXTRACTORS} | {"event_window_totals": (event_window_totals, EVENT_WINDOWS)}

"""Source artifacts made of table rows - a script a customer, a program a part, a package a supplier - and the facts they hold, in SQL.

The SQL twins of the extractors don't parse: they state, row by row, what was put into an artifact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.tables import table

SCRIPT = """-- premiums of %1$d
DECLARE @d AS date = '2024-01-01'
SET @d = %2$d
/* two
   lines */
SELECT t.id, CASE WHEN t.kind = %1$d THEN CASE WHEN t.amt > %2$d THEN 'P' ELSE 'N' END ELSE 'X' END AS bucket, SUM(u.qty) AS q,
  (SELECT MAX(v.n) FROM [Db3].[dbo].[tbl_%2$d] v WHERE v.id = t.id) AS top_n
FROM [Db1].[dbo].[tbl_%1$d] t (nolock)
LEFT JOIN Db2.dbo.ref_%2$d u ON t.id = u.a_%1$d
WHERE t.dt > @d AND t.seg = '%3$s'
GROUP BY t.id, t.kind, t.amt
"""
STATEMENTS = """WITH c_%2$d AS (SELECT a.x FROM base_%1$d a)
INSERT INTO out_%2$d (p) SELECT q.x FROM c_%2$d q
JOIN (SELECT b.x FROM side b) AS s ON s.x = q.x;
UPDATE fin_%1$d SET v = 1
SELECT 1 INTO #tmp FROM C_%2$d
DELETE FROM old_%2$d
"""
PROGRAM = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PGM%1$d.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT FILE-A ASSIGN TO "IN%1$d".
           SELECT FILE-C ASSIGN TO OUT%2$d.
       DATA DIVISION.
       FILE SECTION.
       FD FILE-A.
       01 REC-%1$d.
          05 POLICY-ID PIC X(%2$d).
          05 PREMIUM PIC 9(9)V99.
       FD FILE-B.
       WORKING-STORAGE SECTION.
           COPY CPY%2$d.
       77 CNT PIC 9(4) VALUE %2$d.
      * a comment
       PROCEDURE DIVISION.
       MAIN-STEP.
           OPEN INPUT FILE-A FILE-B
                OUTPUT FILE-C
           PERFORM STEP-%2$d
           PERFORM UNTIL DONE
           CLOSE FILE-A
                 FILE-B.
       STEP-%2$d.
           READ FILE-A
           ADD %2$d TO CNT.
"""
PACKAGE = """<D:Executable xmlns:D="urn:x" D:ObjectName="P%1$d"><D:ConnectionManagers><D:ConnectionManager D:ObjectName="DW" D:CreationName="OLEDB"><D:ObjectData><D:ConnectionManager D:ConnectionString="Server=x;"/></D:ObjectData></D:ConnectionManager></D:ConnectionManagers>
<D:Executables><D:Executable D:ObjectName="T0" D:CreationName="Sql"><D:ObjectData><SqlTaskData SqlStatementSource="TRUNCATE TABLE s%1$d"/></D:ObjectData></D:Executable><D:Executable D:ObjectName="T1" D:CreationName="Pipeline"><D:ObjectData><pipeline><components>
 <component name="SRC" componentClassID="Source"><properties><property name="SqlCommand">select %2$d</property></properties><outputs><output name="O%1$d"/></outputs></component>
 <component name="DST" componentClassID="Destination"><inputs><input name="O%1$d"/></inputs></component></components></pipeline></D:ObjectData></D:Executable></D:Executables>
<D:PrecedenceConstraints><D:PrecedenceConstraint D:From="T0" D:To="T1" D:Value="0"/><D:PrecedenceConstraint D:From="T1" D:To="T2" D:Value="0"/><D:PrecedenceConstraint D:From="L%1$d" D:To="L%1$d" D:Value="0"/></D:PrecedenceConstraints></D:Executable>"""


def _files(rows: DataFrame, name: Column, template: str, *values: str) -> DataFrame:
    return rows.select(name.alias("file_name"), F.format_string(template, *[F.col(v) for v in values]).alias("text"))


def scripts(spark: SparkSession, d: str, template: str = SCRIPT) -> DataFrame:
    rows = table(spark, d, "customer")
    return _files(rows, F.concat(F.lit("q_"), "c_custkey", F.lit(".sql")), template, "c_custkey", "c_nationkey", "c_mktsegment")


def programs(spark: SparkSession, d: str) -> DataFrame:
    return _files(table(spark, d, "part"), F.concat(F.lit("PGM"), "p_partkey", F.lit(".CBL")), PROGRAM, "p_partkey", "p_size")


def packages(spark: SparkSession, d: str) -> DataFrame:
    return _files(table(spark, d, "supplier"), F.concat(F.lit("P"), "s_suppkey", F.lit(".dtsx")), PACKAGE, "s_suppkey", "s_nationkey")


SCRIPTS = "(SELECT 'q_' || c_custkey || '.sql' AS file_name, c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer)"
PROGRAMS = "(SELECT 'PGM' || p_partkey || '.CBL' AS file_name, p_partkey AS k, p_size AS n FROM part)"
PACKAGES = "(SELECT 'P' || s_suppkey || '.dtsx' AS file_name, s_suppkey AS k, s_nationkey AS n FROM supplier)"


def stated(source: str, columns: str, *rows: str) -> str:
    """SQL of the facts that every artifact holds: values of the ``columns`` in terms of k, n and m."""
    names = columns.split()
    lateral = ", ".join(f"({r})" for r in rows)
    return f"SELECT file_name, f.* FROM {source} AS s, LATERAL (VALUES {lateral}) AS f({', '.join(chr(34) + c + chr(34) for c in names)})"

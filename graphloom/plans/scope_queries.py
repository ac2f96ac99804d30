"""Query blocks, owners of columns and facts over scripts of twelve shapes, a shape by customer; the SQL twins state what each shape holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import sql
from graphloom.operators import template
from graphloom.plans import artifacts as A
from graphloom.plans.tables import table

#: Scripts, %1$d a key and %2$d a number of two digits at most.
SHAPES = (
    "SELECT policy_id, policy_number FROM Policy_%1$d",
    "SELECT a.x, y FROM t_%1$d a, dbo.u_%2$d b, w\nWHERE a.k = b.k AND z = %2$d",
    "SELECT p FROM a_%1$d WHERE x = %2$d\nSELECT q FROM b WHERE y = 2\nGO\nUPDATE c SET z = 3, v = w WHERE r = %1$d",
    "WITH c AS (SELECT i.id, v FROM base_%1$d i) INSERT INTO out_%2$d (p) SELECT id FROM c\nSELECT id FROM c",
    "SELECT t.a, (SELECT MAX(t.b) FROM u_%1$d t WHERE t.c = o.d) AS m\nFROM v_%2$d t JOIN w o ON o.e = t.f WHERE EXISTS (SELECT 1 FROM x WHERE g = h)",
    "SELECT d.s FROM (SELECT s FROM e_%1$d UNION ALL SELECT r FROM f_%2$d) d ORDER BY s",
    "SELECT \"Q\".\"A b\", '--no' AS n /* c */ FROM \"My Schema\".\"T_%1$d\" \"Q\" -- FROM x\nLEFT JOIN [B c].[D_%2$d] e ON e.f = \"Q\".g",
    "DECLARE @a int = %1$d, @b varchar(10) = 'x'\nSET @b += 'y'\nSELECT h FROM t_%2$d WHERE h > @a AND k IN (1, 2)",
    "SELECT g, CASE st WHEN 1 THEN 'a' ELSE 'b' END AS c, SUM(CAST(am AS int)) tot, DATEADD(day, 1, dt)\nFROM s_%1$d GROUP BY g, st, dt HAVING SUM(am) > %2$d ORDER BY tot",
    "MERGE INTO tg_%1$d AS t USING sr_%2$d AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, x) VALUES (s.id, s.x);",
    "UPDATE t SET x = s.y, z = 1 FROM tb_%1$d t JOIN sc_%2$d s ON s.id = t.id WHERE m = 1; DELETE FROM old_%1$d WHERE q = 2",
    "SELECT a.x, y, e.z FROM m_%1$d a JOIN n_%2$d b USING (id) CROSS APPLY (SELECT z FROM dp WHERE dp.k = a.k) e",
)


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """A script a customer, of the shape that its key names."""
    texts = F.array(*[F.format_string(s, F.col("c_custkey"), F.col("c_nationkey")) for s in SHAPES])
    return table(spark, d, "customer").select(F.concat(F.lit("q_"), "c_custkey", F.lit(".sql")).alias("file_name"), F.get(texts, (F.col("c_custkey") % len(SHAPES)).cast("int")).alias("text"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return sql.prepared(scripts(spark, d))


def sql_scopes(spark: SparkSession, d: str) -> DataFrame:
    return sql.scopes(_prepared(spark, d)).drop("text")


def sql_column_owners(spark: SparkSession, d: str) -> DataFrame:
    owners = sql.column_owners(_prepared(spark, d))
    return owners.select("file_name", "scope", "qualifier", "column", "owner", "owner_kind", "status", F.size("candidates").alias("candidates")).distinct()


def sql_shape_facts(spark: SparkSession, d: str) -> DataFrame:
    """Tables, joins, conditions, groups, variables and rules of all shapes: (file_name, kind, a, b, c)."""
    found = _prepared(spark, d)
    none = F.lit(None).cast("string")
    fact = lambda rows, kind, *names: rows.select("file_name", F.lit(kind).alias("kind"), *[(F.col(n) if n else none).alias(c) for n, c in zip((*names, None, None)[:3], "abc", strict=True)])
    parts = [
        fact(sql.tables(found), "table", "source", "table", "alias"),
        fact(sql.joins(found), "join", "join_type", "table", "condition"),
        fact(sql.where_conditions(found), "where", "condition"),
        fact(sql.group_by(found), "group", "columns"),
        fact(sql.variables(found), "variable", "name", "datatype", "default_value"),
        fact(sql.set_statements(found), "set", "variable", "value"),
        fact(sql.business_rules(found), "rule", "condition", "result", "target_column"),
    ]
    return reduce(DataFrame.unionByName, parts)


def sql_table_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = template.table_rows(_prepared(spark, d))
    return rows.select("file_name", "database_name", "schema_name", "table_name", "alias", F.array_join("column_list", ", ").alias("columns"), F.array_join("ambiguous", ", ").alias("ambiguous"), "joins")


def _owned(scope: int, owner: str, kind: str, *columns: str) -> list[str]:
    """Rows of owned columns, written with their qualifier."""
    rows = []
    for c in columns:
        qualifier, _, name = c.rpartition(".")
        rows.append(f"{scope}, {f"'{qualifier}'" if qualifier else 'NULL'}, '{name}', {owner}, '{kind}', 'owned', 1")
    return rows


def _ambiguous(scope: int, of: int, *columns: str) -> list[str]:
    return [f"{scope}, NULL, '{c}', NULL, NULL, 'ambiguous', {of}" for c in columns]


#: Of each shape: its blocks, its owners, its facts, and the rows of its tables.
_SCOPES = (
    ["1, NULL, 1, 'select', NULL, 1, 1"],
    ["1, NULL, 1, 'select', NULL, 1, 2"],
    ["1, NULL, 1, 'select', NULL, 1, 1", "2, NULL, 2, 'select', NULL, 2, 2", "3, NULL, 3, 'statement', NULL, 3, 3", "4, NULL, 4, 'statement', NULL, 4, 4"],
    ["1, NULL, 1, 'statement', NULL, 1, 1", "2, 1, 1, 'cte', 'c', 1, 1", "3, NULL, 1, 'select', NULL, 1, 1", "4, NULL, 2, 'select', NULL, 2, 2"],
    ["1, NULL, 1, 'select', NULL, 1, 2", "2, 1, 1, 'subquery', NULL, 1, 1", "3, 1, 1, 'subquery', NULL, 2, 2"],
    ["1, NULL, 1, 'select', NULL, 1, 1", "2, 1, 1, 'derived', 'd', 1, 1", "3, 1, 1, 'union', 'd', 1, 1"],
    ["1, NULL, 1, 'select', NULL, 1, 2"],
    ["1, NULL, 1, 'statement', NULL, 1, 1", "2, NULL, 2, 'statement', NULL, 2, 2", "3, NULL, 3, 'select', NULL, 3, 3"],
    ["1, NULL, 1, 'select', NULL, 1, 2"],
    ["1, NULL, 1, 'statement', NULL, 1, 1"],
    ["1, NULL, 1, 'statement', NULL, 1, 1", "2, NULL, 2, 'statement', NULL, 1, 1"],
    ["1, NULL, 1, 'select', NULL, 1, 1", "2, 1, 1, 'derived', 'e', 1, 1"],
)
_OWNERS = (
    _owned(1, "'Policy_' || k", "table", "policy_id", "policy_number"),
    [*_owned(1, "'t_' || k", "table", "a.x", "a.k"), *_owned(1, "'dbo.u_' || n", "table", "b.k"), *_ambiguous(1, 3, "y", "z")],
    [*_owned(1, "'a_' || k", "table", "p", "x"), *_owned(2, "'b'", "table", "q", "y"), *_owned(4, "'c'", "target", "z", "v", "w", "r")],
    [*_owned(2, "'base_' || k", "table", "i.id", "v"), *_owned(1, "'out_' || n", "target", "p"), *_owned(3, "'c'", "cte", "id"), *_owned(4, "'c'", "table", "id")],
    [*_owned(1, "'v_' || n", "table", "t.a", "t.f"), *_owned(1, "'w'", "table", "o.e"), *_owned(2, "'u_' || k", "table", "t.b", "t.c"), *_owned(2, "'w'", "table", "o.d"), *_owned(3, "'x'", "table", "g", "h")],
    [*_owned(1, "'d'", "derived", "d.s", "s"), *_owned(2, "'e_' || k", "table", "s"), *_owned(3, "'f_' || n", "table", "r")],
    [*_owned(1, "'My Schema.T_' || k", "table", "Q.A b", "Q.g"), *_owned(1, "'B c.D_' || n", "table", "e.f")],
    _owned(3, "'t_' || n", "table", "h", "k"),
    _owned(1, "'s_' || k", "table", "g", "st", "am", "dt"),
    [*_owned(1, "'tg_' || k", "target", "t.id", "v", "id", "x"), *_owned(1, "'sr_' || n", "table", "s.id", "s.v", "s.x")],
    [*_owned(1, "'tb_' || k", "table", "x", "z", "t.id"), *_owned(1, "'sc_' || n", "table", "s.y", "s.id"), *_ambiguous(1, 2, "m"), *_owned(2, "'old_' || k", "table", "q")],
    [*_owned(1, "'m_' || k", "table", "a.x"), *_ambiguous(1, 3, "y"), *_owned(1, "'e'", "derived", "e.z"), *_owned(2, "'dp'", "table", "z", "dp.k"), *_owned(2, "'m_' || k", "table", "a.k")],
)
_FACTS = (
    ["'table', 'FROM', 'Policy_' || k, NULL"],
    ["'table', 'FROM', 't_' || k, 'a'", "'table', 'FROM', 'dbo.u_' || n, 'b'", "'table', 'FROM', 'w', NULL", "'where', 'a.k = b.k AND z = ' || n, NULL, NULL"],
    ["'table', 'FROM', 'a_' || k, NULL", "'table', 'FROM', 'b', NULL", "'where', 'x = ' || n, NULL, NULL", "'where', 'y = 2', NULL, NULL", "'where', 'r = ' || k, NULL, NULL"],
    ["'table', 'FROM', 'base_' || k, 'i'", "'table', 'FROM', 'c', NULL", "'table', 'FROM', 'c', NULL"],
    ["'table', 'FROM', 'u_' || k, 't'", "'table', 'FROM', 'v_' || n, 't'", "'table', 'JOIN', 'w', 'o'", "'table', 'FROM', 'x', NULL", "'join', 'JOIN', 'w', 'o.e = t.f'", "'where', 't.c = o.d', NULL, NULL", "'where', 'EXISTS (SELECT 1 FROM x WHERE g = h)', NULL, NULL", "'where', 'g = h', NULL, NULL"],
    ["'table', 'FROM', 'e_' || k, NULL", "'table', 'FROM', 'f_' || n, NULL"],
    ["'table', 'FROM', 'My Schema.T_' || k, 'Q'", "'table', 'JOIN', 'B c.D_' || n, 'e'", "'join', 'LEFT JOIN', 'B c.D_' || n, 'e.f = \"Q\".g'"],
    ["'table', 'FROM', 't_' || n, NULL", "'where', 'h > @a AND k IN (1, 2)', NULL, NULL", "'variable', '@a', 'int', CAST(k AS VARCHAR)", "'variable', '@b', 'varchar(10)', '''x'''", "'set', '@b', '@b + ''y''', NULL"],
    ["'table', 'FROM', 's_' || k, NULL", "'rule', 'st = 1', '''a''', 'c'", "'group', 'g, st, dt', NULL, NULL"],
    ["NULL, NULL, NULL, NULL"],
    ["'table', 'FROM', 'tb_' || k, 't'", "'table', 'JOIN', 'sc_' || n, 's'", "'table', 'FROM', 'old_' || k, NULL", "'join', 'JOIN', 'sc_' || n, 's.id = t.id'", "'where', 'm = 1', NULL, NULL", "'where', 'q = 2', NULL, NULL"],
    ["'table', 'FROM', 'm_' || k, 'a'", "'table', 'JOIN', 'n_' || n, 'b'", "'table', 'FROM', 'dp', NULL", "'where', 'dp.k = a.k', NULL, NULL"],
)
_TABLES = (
    ["NULL, NULL, 'Policy_' || k, NULL, 'policy_id, policy_number', '', NULL"],
    ["NULL, NULL, 't_' || k, 'a', 'k, x', 'y, z', NULL", "NULL, 'dbo', 'u_' || n, 'b', 'k', 'y, z', NULL", "NULL, NULL, 'w', NULL, '', 'y, z', NULL"],
    ["NULL, NULL, 'a_' || k, NULL, 'p, x', '', NULL", "NULL, NULL, 'b', NULL, 'q, y', '', NULL", "NULL, NULL, 'c', NULL, 'r, v, w, z', '', NULL"],
    ["NULL, NULL, 'base_' || k, 'i', 'id, v', '', NULL", "NULL, NULL, 'out_' || n, NULL, 'p', '', NULL", "NULL, NULL, 'c', NULL, 'id', '', NULL", "NULL, NULL, 'c', NULL, 'id', '', NULL"],
    ["NULL, NULL, 'u_' || k, 't', 'b, c', '', NULL", "NULL, NULL, 'v_' || n, 't', 'a, f', '', NULL", "NULL, NULL, 'w', 'o', 'd, e', '', 'JOIN ON o.e = t.f'", "NULL, NULL, 'x', NULL, 'g, h', '', NULL"],
    ["NULL, NULL, 'e_' || k, NULL, 's', '', NULL", "NULL, NULL, 'f_' || n, NULL, 'r', '', NULL"],
    ["NULL, 'My Schema', 'T_' || k, 'Q', 'A b, g', '', NULL", "NULL, 'B c', 'D_' || n, 'e', 'f', '', 'LEFT JOIN ON e.f = \"Q\".g'"],
    ["NULL, NULL, 't_' || n, NULL, 'h, k', '', NULL"],
    ["NULL, NULL, 's_' || k, NULL, 'am, dt, g, st', '', NULL"],
    ["NULL, NULL, 'tg_' || k, 't', 'id, v, x', '', NULL", "NULL, NULL, 'sr_' || n, 's', 'id, v, x', '', NULL"],
    ["NULL, NULL, 'tb_' || k, 't', 'id, x, z', 'm', NULL", "NULL, NULL, 'sc_' || n, 's', 'id, y', 'm', 'JOIN ON s.id = t.id'", "NULL, NULL, 'old_' || k, NULL, 'q', '', NULL"],
    ["NULL, NULL, 'm_' || k, 'a', 'k, x', 'y', NULL", "NULL, NULL, 'n_' || n, 'b', '', 'y', NULL", "NULL, NULL, 'dp', NULL, 'k, z', '', NULL"],
)


def _by_shape(columns: str, rows: tuple[list[str], ...]) -> str:
    first = columns.split()[0]
    parts = [A.stated(f"(SELECT * FROM {A.SCRIPTS} WHERE k % {len(SHAPES)} = {i})", columns, *r) for i, r in enumerate(rows)]
    return f'SELECT * FROM ({" UNION ALL ".join(parts)}) f WHERE "{first}" IS NOT NULL' if first == "kind" else " UNION ALL ".join(parts)


QUERIES = {
    "sql_scopes": (sql_scopes, _by_shape("scope parent statement kind name line end_line", _SCOPES)),
    "sql_column_owners": (sql_column_owners, _by_shape("scope qualifier column owner owner_kind status candidates", _OWNERS)),
    "sql_shape_facts": (sql_shape_facts, _by_shape("kind a b c", _FACTS)),
    "sql_table_columns": (sql_table_columns, _by_shape("database_name schema_name table_name alias columns ambiguous joins", _TABLES)),
}

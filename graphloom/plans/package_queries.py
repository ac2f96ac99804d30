"""Queries of knowledge packages, templates by kind of file, the file catalogue, and formatted extracts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import sql
from graphloom.operators import package, template
from graphloom.plans import artifacts as A
from graphloom.plans.tables import SOURCE_FILES_SQL, source_files, table

_TABLES = ("'Db1.dbo.tbl_' || k", "'Db2.dbo.ref_' || n", "'Db3.dbo.tbl_' || n")
_COLUMNS = ("'t.id'", "'t.kind'", "'t.amt'", "'u.qty'", "'v.n'", "'v.id'", "'Db2.dbo'", "'u.a_' || k", "'t.dt'", "'t.seg'")
_ROOT = "'ARTIFACT:' || file_name"
_RULE = "'TRANSFORMATION:' || file_name || ':CASE-1'"


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return A.scripts(spark, d).withColumn("source_type", F.lit("sql"))


def _elements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _scripts(spark, d)
    return package.graph_elements(files, *package.script_facts(sql.prepared(files)))


def package_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d)[0]


PACKAGE_NODES = A.stated(A.SCRIPTS, "id label name", f"{_ROOT}, 'Artifact', file_name", f"{_RULE}, 'Transformation', 'CASE-1'", *[f"'TABLE:' || {t}, 'Table', {t}" for t in _TABLES], *[f"'COLUMN:' || {c}, 'Column', {c}" for c in _COLUMNS])


def package_edges(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d)[1]


PACKAGE_EDGES = A.stated(A.SCRIPTS, "src type dst", *[f"{_ROOT}, 'CONTAINS', 'TABLE:' || {t}" for t in _TABLES], *[f"{_ROOT}, 'CONTAINS', 'COLUMN:' || {c}" for c in _COLUMNS], f"'COLUMN:t.kind', 'INPUT_TO', {_RULE}", f"'COLUMN:t.amt', 'INPUT_TO', {_RULE}", "'TABLE:Db1.dbo.tbl_' || k, 'JOINS_WITH', 'TABLE:Db2.dbo.ref_' || n")


def package_ids(spark: SparkSession, d: str) -> DataFrame:
    return package.package_ids(source_files(spark, d).withColumn("source_type", F.lit("text")))


PACKAGE_IDS = f"SELECT file_name, 'PKG-TEXT-' || file_name || '-' || left(sha256(coalesce(text, '')), 8) AS package_id FROM {SOURCE_FILES_SQL} f"


def canonical_metadata(spark: SparkSession, d: str) -> DataFrame:
    files = _scripts(spark, d)
    return package.canonical(files, *package.script_facts(sql.prepared(files)))


CANONICAL = A.stated(A.SCRIPTS, "tables columns transformations relations", f"list_sort([{', '.join(_TABLES)}]), list_sort([{', '.join(_COLUMNS)}]), 1::BIGINT, 1::BIGINT")


def cross_file_flows(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with the edges of other files that it meets in its target."""
    return package.flows_across_files(_elements(spark, d)[1])


CROSS_FILE_FLOWS = f"""WITH e AS (SELECT DISTINCT file_name, src, type, dst FROM ({PACKAGE_EDGES}) x)
SELECT target, source, file_name, type, other_type, other_kind, o.s AS other, o.f AS other_file, flows FROM (
  SELECT r.dst AS target, r.src AS source, r.file_name, r.type, r2.type AS other_type, split_part(r2.src, ':', 1) AS other_kind, min({{'f': r2.file_name, 's': r2.src}}) AS o, count(*) AS flows
  FROM e r JOIN e r2 ON r.dst = r2.dst AND r.file_name <> r2.file_name GROUP BY 1, 2, 3, 4, 5, 6) p"""


def template_by_file(spark: SparkSession, d: str) -> DataFrame:
    """One template over scripts, programs and packages; each file goes to the reader of its extension."""
    files = A.scripts(spark, d).unionByName(A.programs(spark, d)).unionByName(A.packages(spark, d))
    return template.extract(template.rows_of(files), template.parse(["Source File", "Database", "Schema", "Table", "Columns"]))


def _template_sql() -> str:
    fields = "Database Schema Table Columns"
    parts = [
        A.stated(A.SCRIPTS, fields, "'Db3', 'dbo', 'tbl_' || n, 'id, n'", "'Db1', 'dbo', 'tbl_' || k, 'amt, dt, id, kind, seg'", "'Db2', 'dbo', 'ref_' || n, 'a_' || k || ', qty'"),
        A.stated(A.PROGRAMS, fields, "'PGM' || k, 'FILE', 'REC-' || k, 'POLICY-ID, PREMIUM'", "'PGM' || k, 'WORKING-STORAGE', 'CNT', 'UNKNOWN / Not specified'"),
        A.stated(A.PACKAGES, fields, "'P' || k, 'T1', 'SRC', 'SqlCommand'", "'P' || k, 'T1', 'DST', 'UNKNOWN / Not specified'"),
    ]
    return 'SELECT file_name AS "Source File", * EXCLUDE (file_name) FROM (' + " UNION ALL ".join(parts) + ") r"


def file_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Files with the domain of the package of their stem, packages being parts by brand; technologies by extension."""
    parts = table(spark, d, "part").select(F.concat(F.lit("DOC_"), "p_size", F.lit(".json")).alias("file_name"), F.col("p_type").alias("domain"), F.col("p_partkey").alias("at"))
    return package.with_metadata(source_files(spark, d).select("file_name"), parts)


FILE_CATALOG = f"WITH p AS (SELECT 'doc_' || p_size AS stem, arg_max(p_type, p_partkey) AS domain FROM part GROUP BY 1) SELECT f.file_name, coalesce(p.domain, 'General') AS domain FROM {SOURCE_FILES_SQL} f LEFT JOIN p ON p.stem = split_part(f.file_name, '.', 1)"


def column_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The columns of extracted tables, one row each with its place."""
    rows = template.table_rows(sql.prepared(A.scripts(spark, d)))
    return rows.select("file_name", F.coalesce("schema_name", F.lit("default")).alias("schema_name"), F.col("table_name"), F.posexplode("column_list").alias("at", "column")).withColumn("column_order", F.col("at") + 1).drop("at")


COLUMN_CATALOG = A.stated(A.SCRIPTS, "schema_name table_name column column_order", *[f"'dbo', {t}, {c}, {i}" for t, cs in (("'tbl_' || n", ("'id'", "'n'")), ("'tbl_' || k", ("'amt'", "'dt'", "'id'", "'kind'", "'seg'")), ("'ref_' || n", ("'a_' || k", "'qty'"))) for i, c in enumerate(cs, 1)])


def fixed_width_extract(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fields of fixed width: padded codes, dates without separators, signed amounts with leading zeros, a ladder of codes."""
    amount = F.round("o_totalprice", 2).cast("decimal(11,2)")
    cents = F.lpad(F.abs(amount * 100).cast("long").cast("string"), 11, "0")
    code = F.when(F.col("o_orderpriority").like("1%"), "NEW").when((F.col("o_orderstatus") == "F") & (amount >= 0), "CLS").when(F.col("o_orderstatus") == "O", "OPN").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", F.rpad(F.coalesce(code, F.lit("")), 6, " ").alias("code"), F.right(F.rtrim("o_orderpriority"), F.lit(3)).alias("tail"), F.date_format("o_orderdate", "MMddyyyy").alias("day"), F.concat(F.when(amount < 0, "-").otherwise("+"), cents).alias("amount"))


FIXED_WIDTH = """SELECT o_orderkey, rpad(CASE WHEN o_orderpriority LIKE '1%' THEN 'NEW' WHEN o_orderstatus = 'F' AND a >= 0 THEN 'CLS' WHEN o_orderstatus = 'O' THEN 'OPN' ELSE '' END, 6, ' ') AS code, right(rtrim(o_orderpriority), 3) AS tail, strftime(o_orderdate, '%m%d%Y') AS day, CASE WHEN a < 0 THEN '-' ELSE '+' END || lpad(CAST(CAST(abs(a * 100) AS BIGINT) AS VARCHAR), 11, '0') AS amount
FROM (SELECT *, CAST(round(o_totalprice, 2) AS DECIMAL(11,2)) AS a FROM orders)"""


def star_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with all their look-ups, none lost where one fails; totals by region and brand."""
    t = lambda name: table(spark, d, name)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    lines = lines.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    lines = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier").filter("s_acctbal >= 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines.groupBy(F.coalesce("r_name", F.lit("")).alias("region"), F.coalesce("p_brand", F.lit("")).alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("solvent"))


STAR_LOOKUPS = """SELECT coalesce(r_name, '') AS region, coalesce(p_brand, '') AS brand, count(*) AS n, count(s_suppkey) AS solvent FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def rating(spark: SparkSession, d: str) -> DataFrame:
    """Premiums of orders: line amounts with at most a tenth off, never under a least premium."""
    exact = lambda c, kind: F.round(c, 2).cast(kind)
    line = exact("l_extendedprice", "decimal(16,2)") * exact(1 - F.least("l_discount", F.lit(0.1)), "decimal(4,2)")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(line).cast("decimal(28,4)").alias("premium"), F.countDistinct("l_partkey").alias("coverages"))
    return sums.select("l_orderkey", "coverages", F.greatest("premium", F.lit(5000).cast("decimal(28,4)")).alias("premium"))


RATING = "SELECT l_orderkey, count(DISTINCT l_partkey) AS coverages, greatest(CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(16,2)) * CAST(round(1 - least(l_discount, 0.1), 2) AS DECIMAL(4,2))) AS DECIMAL(28,4)), CAST(5000 AS DECIMAL(28,4))) AS premium FROM lineitem GROUP BY l_orderkey"


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources named in a text before those of its row, each once in that order; the byte where the first line ends; a shown length."""
    cited = F.split(F.regexp_replace(F.coalesce("lang", F.lit("")), "e", "e,"), ",")
    sources = F.array_distinct(F.concat(cited, F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))))
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, d, "documents").select("doc_id", F.array_join(sources, "|").alias("sources"), F.octet_length(first).alias("first_line_bytes"), F.format_number(F.coalesce("n_chars", F.lit(0)), 0).alias("shown"))


CITED_SOURCES = """WITH c AS (SELECT doc_id, string_split(replace(coalesce(lang, ''), 'e', 'e,'), ',') || [coalesce(source, ''), coalesce(lang, '')] AS l, octet_length(encode(split_part(coalesce(text, ''), chr(10), 1))) AS b, format('{:,}', coalesce(n_chars, 0)) AS shown FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS sources, CAST(b AS INTEGER) AS first_line_bytes, shown FROM c"""

QUERIES = {
    f.__name__: (f, text)
    for f, text in (
        (package_nodes, PACKAGE_NODES), (package_edges, PACKAGE_EDGES), (package_ids, PACKAGE_IDS), (canonical_metadata, CANONICAL), (cross_file_flows, CROSS_FILE_FLOWS), (template_by_file, _template_sql()),
        (file_catalog, FILE_CATALOG), (column_catalog, COLUMN_CATALOG), (fixed_width_extract, FIXED_WIDTH), (star_lookups, STAR_LOOKUPS), (rating, RATING), (cited_sources, CITED_SOURCES),
    )
}

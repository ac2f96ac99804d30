"""Units of programs made of whole documents - a paragraph a sentence - and their evidence; the SQL twins parse the programs on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import cobol, units
from graphloom.plans.tables import table

_HEAD = "       IDENTIFICATION DIVISION.\n       NO-UNIT.\n       PROCEDURE DIVISION.\n           MOVE 1 TO X.\n       P-0.\n           "


def programs(spark: SparkSession, d: str) -> DataFrame:
    """A program a document: a paragraph a sentence, most of one name, all later words behind MOVE; lines end in three ways."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ".\n       S-1.  \n           MOVE ")
    whole = F.concat(F.lit(_HEAD), text, F.lit("\n           PERFORM P-0.\n \n\n"))
    ended = F.when(F.col("doc_id") % 3 == 0, F.replace(whole, F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 7 == 0, F.replace(whole, F.lit("\n"), F.lit("\r"))).otherwise(whole)
    return table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id"), F.lit(".CBL")).alias("file_name"), ended.alias("text"))


def cobol_units(spark: SparkSession, d: str) -> DataFrame:
    return units.units(programs(spark, d)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def char_to_byte(spark: SparkSession, d: str) -> DataFrame:
    """Eleven places of each document, from its start to its end, in bytes."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_name"), "text")
    tenth = F.explode(F.sequence(F.lit(0), F.lit(10)))
    return units.byte_places(files, files.select("file_name", F.length("text").alias("n"), tenth.alias("i")).select("file_name", F.floor(F.col("n") * F.col("i") / 10).alias("place")).distinct().filter("place IS NOT NULL"))


def cobol_unit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Statements and relations of each unit, counted, over programs with plain line ends."""
    files = programs(spark, d).filter(~F.contains("text", F.lit("\r")))
    found = units.unit_evidence(files)
    total = lambda c: F.aggregate(F.map_values(F.col(c)), F.lit(0).cast("long"), lambda a, b: a + b)
    moves = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit("move")), F.lit(0).cast("long"))
    return found.select("file_name", "unit_no", F.coalesce(total("unit_counts"), F.lit(0).cast("long")).alias("statements"), moves("unit_counts").alias("moves"), moves("file_counts").alias("file_moves"), F.size("operations").alias("details"), F.array_join(F.transform("relations", lambda r: F.concat_ws(" ", r["source"], r["type"], r["target"])), "; ").alias("relations"))


_TEXT = """concat('{h}', replace(coalesce(text, ''), '. ', E'.\\n       S-1.  \\n           MOVE '), E'\\n           PERFORM P-0.\\n \\n\\n')"""
_WHOLE = _TEXT.format(h="' || E'" + _HEAD.replace("\n", "\\n") + "' || '")
_LINES = rf"""(SELECT file_name, unnest(raws) AS raw, generate_subscripts(raws, 1) AS line FROM (SELECT 'D' || doc_id || '.CBL' AS file_name, regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN replace(whole, E'\n', E'\r\n') WHEN doc_id % 7 = 0 THEN replace(whole, E'\n', E'\r') ELSE whole END, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') AS raws FROM (SELECT doc_id, {_WHOLE} AS whole FROM documents) w) x)"""
_NUMBERED = rf"""(SELECT *, count(head) OVER (PARTITION BY file_name ORDER BY line) AS unit_no FROM (SELECT *, coalesce(sum(length(raw)) OVER before, 0)::BIGINT AS o, coalesce(sum(strlen(raw)) OVER before, 0)::BIGINT AS b, CASE WHEN line > begun AND head_name NOT IN ('', 'SECTION', 'DIVISION') THEN head_name END AS head
FROM (SELECT *, min(CASE WHEN contains(upper(raw), 'PROCEDURE DIVISION') THEN line END) OVER (PARTITION BY file_name) AS begun, upper(regexp_extract(rtrim(raw, E'\r\n'), '^ {{0,7}}([A-Za-z0-9][A-Za-z0-9-]*)\.\s*$', 1)) AS head_name FROM {_LINES} l) k WINDOW before AS (PARTITION BY file_name ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h)"""
_UNITS = rf"""(SELECT file_name, unit_no, max(head) AS unit, min(line)::INT AS start_line, max(line)::INT AS end_line, min(o) AS o, min(b) AS b, string_agg(raw, '' ORDER BY line) AS raw FROM {_NUMBERED} n WHERE unit_no > 0 GROUP BY 1, 2)"""
COBOL_UNITS = rf"""SELECT file_name, unit_no, unit, start_line, end_line, o + indent AS start_offset, o + indent + length(t) AS end_offset, b + indent AS start_byte, b + indent + strlen(t) AS end_byte, sha256(t) AS text_sha256
FROM (SELECT *, length(raw) - length(ltrim(raw, ' ')) AS indent, regexp_replace(ltrim(raw, ' '), '\s+$', '') AS t FROM {_UNITS} u) q"""
CHAR_TO_BYTE = "SELECT DISTINCT doc_id::VARCHAR AS file_name, (length(text) * i // 10)::BIGINT AS place, strlen(substr(text, 1, length(text) * i // 10))::BIGINT AS byte FROM documents, range(0, 11) r(i) WHERE length(text) > 0"
_OPS = ", ".join(f"'{o}'" for o in cobol.OPERATIONS)
COBOL_UNIT_EVIDENCE = rf"""WITH l AS (SELECT *, upper(regexp_extract(raw, '^\s*([A-Za-z0-9-]+)', 1)) AS word FROM {_NUMBERED} n WHERE NOT contains(raw, E'\r') AND line > begun),
s AS (SELECT file_name, unit_no, count(*) FILTER (WHERE word IN ({_OPS}) AND substr(raw, 7, 1) <> '*') AS statements, count(*) FILTER (WHERE word = 'MOVE') AS moves, max(head) AS unit FROM l GROUP BY 1, 2)
SELECT file_name, unit_no, statements, moves, file_moves::BIGINT AS file_moves, statements::INT AS details, array_to_string(list_sort([file_name || ' CONTAINS_PARAGRAPH ' || unit] || CASE WHEN unit IN ('P-0', last_unit) THEN [last_unit || ' PERFORMS P-0'] ELSE [] END), '; ') AS relations
FROM (SELECT *, sum(moves) OVER (PARTITION BY file_name) AS file_moves, last_value(unit) OVER (PARTITION BY file_name ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_unit FROM s) q WHERE unit_no > 0"""


QUERIES = {"cobol_units": (cobol_units, COBOL_UNITS), "char_to_byte": (char_to_byte, CHAR_TO_BYTE), "cobol_unit_evidence": (cobol_unit_evidence, COBOL_UNIT_EVIDENCE)}

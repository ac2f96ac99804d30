"""Extraction by a user's template: the requested fields become the columns of the result."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import collapse, suffix_of
from graphloom.functions.vocabulary import CONCEPTS
from graphloom.operators.windows import dealt, matched

UNKNOWN = "UNKNOWN / Not specified"
DEFAULT = ("Schema", "Database", "Table", "Columns")
#: Concepts of fields and the columns of extracted rows that answer them.
_ANSWERS = {"schema": "schema_name", "database": "database_name", "table": "table_name", "column": "column", "columns": "columns", "alias": "alias", "source_file": "file_name", "joins": "joins", "transformation": "transformation", "source_table": "table_name", "program": "database_name", "package": "database_name"}


@dataclass(frozen=True)
class Template:
    fields: tuple[tuple[str, str], ...]  # name as requested, concept

    @property
    def row_per_column(self) -> bool:
        concepts = {c for _, c in self.fields}
        return bool(concepts & {"column", "transformation", "data_type"}) and "columns" not in concepts


def concept(field: str) -> str:
    """What a requested field means: as it stands, without brackets, with other separators, by its parts, by the longest name in it."""
    name = field.strip().lower()
    forms = (name, re.sub(r"\([^)]*\)", "", name).strip(), re.sub(r"[_-]+", " ", name).strip(), re.sub(r"[\s-]+", "_", name).strip())
    for form in forms:
        if form in CONCEPTS:
            return CONCEPTS[form]
    if re.search(r"[/\\]| or | & ", name):
        for part in filter(None, (p.strip() for p in re.split(r"[/\\&]|\bor\b", name))):
            if (found := concept(part)) != "custom":
                return found
    inside = [n for n in CONCEPTS if len(n) >= 3 and n in name]
    return CONCEPTS[max(inside, key=len)] if inside else "custom"


def parse(template: str | list[str] | None) -> Template:
    """A template from a list, a JSON array, the head of a Markdown table, or names between commas, tabs or line breaks."""
    if isinstance(template, list):
        names = [str(x).strip() for x in template]
    else:
        text = (template or "").strip()
        names = []
        if text.startswith("[") and text.endswith("]"):
            try:
                names = [str(x).strip() for x in json.loads(text)]
            except ValueError:
                names = []
        if not names:
            mark = next((m for m in "|,\t\n" if m in text), None)
            head = next((x for x in text.splitlines() if x.strip()), "") if mark == "|" else text
            names = [p.strip() for p in (head.split(mark) if mark else [text])]
            names = [n for n in names if not re.fullmatch(r":?-+:?", n)]
    names = [n for n in names if n] or list(DEFAULT)
    return Template(tuple((n, concept(n)) for n in names))


def table_rows(sql: DataFrame) -> DataFrame:
    """One row per table that a script (file_name, text) reads or changes: parts of its name, alias, its columns, its joins.

    Columns go to the table that owns them in their query block. A plain column of a block with several tables is ambiguous and
    named so with each of them. Without a part of the name it is null.
    """
    from graphloom.extract import sql as S

    words = S.tokens(sql)
    sources, owners = S.resolved(sql, words)
    parts = F.split("name", r"\.")
    n = F.size(parts)
    named = sources.filter("kind <> 'derived'").select("file_name", F.element_at(parts, -1).alias("table_name"), F.when(n > 1, F.get(parts, n - 2)).alias("schema_name"), F.when(n > 2, F.get(parts, n - 3)).alias("database_name"), "alias", F.lower("name").alias("key"), "pos")
    of_each = owners.filter("column <> '*'").select("file_name", F.explode("candidates").alias("pos"), "column", "status")
    listed = lambda status: F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("column"))))
    columns = of_each.groupBy("file_name", "pos").agg(listed("owned").alias("column_list"), listed("ambiguous").alias("ambiguous"))
    joined = dealt(S.joins(sql, words=words)).groupBy("file_name", F.lower("table").alias("key")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ON ", "join_type", "condition"))), "; ").alias("joins"))
    full = matched(matched(named, columns, ["file_name", "pos"], "left"), joined, ["file_name", "key"], "left")
    none = F.array().cast("array<string>")
    return full.drop("key").withColumns({c: F.coalesce(c, none) for c in ("column_list", "ambiguous")})


def program_rows(programs: DataFrame) -> DataFrame:
    """One row per record or level-77 item of a COBOL program: section as schema, PROGRAM-ID as database, its named items as columns.

    Formulas of COMPUTE, over all their lines, are the transformation of the item they compute.
    """
    from graphloom.extract import cobol

    lines = cobol.program_lines(programs)
    sections = lines.select("file_name", "line", "section")
    program = lines.groupBy("file_name").agg(F.max(F.nullif(F.upper(F.regexp_extract("code", r"(?i)PROGRAM-ID\.\s*([A-Za-z0-9-]+)", 1)), F.lit(""))).alias("program"))
    computed = programs.select("file_name", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\bCOMPUTE\s+([A-Za-z0-9-]++[^.]*+)"), F.lit(1))).alias("formula"))
    formulas = computed.select("file_name", F.upper(F.regexp_extract("formula", r"^([A-Za-z0-9-]+)", 1)).alias("name"), collapse(F.col("formula")).alias("formula"))
    items = matched(cobol.variables(lines), formulas, ["file_name", "name"], "left")
    groups = items.groupBy("file_name", "record").agg(F.min("line").alias("line"), F.array_sort(F.collect_set(F.struct("line", "name"))).alias("items"), F.array_join(F.array_sort(F.collect_set("formula")), "; ").alias("formulas"))
    named = matched(matched(groups, sections, ["file_name", "line"]), program, "file_name")
    none = F.lit(None).cast("string")
    return named.select("file_name", F.col("record").alias("table_name"), F.col("section").alias("schema_name"), F.col("program").alias("database_name"), none.alias("alias"), F.filter(F.col("items.name"), lambda x: x != F.col("record")).alias("column_list"), none.alias("joins"), F.nullif("formulas", F.lit("")).alias("transformation"))


def package_rows(packages: DataFrame) -> DataFrame:
    """One row per component of a package: its task as schema, the package as database, its properties as columns."""
    from graphloom.extract import ssis

    found = ssis.facts(packages)
    package = found.filter("kind = 'package'").select("file_name", F.col("name").alias("database_name"))
    statements = ssis.sql_statements(found).groupBy("file_name", "task", "name").agg(F.array_join(F.array_sort(F.collect_set("sql")), "; ").alias("transformation"))
    rows = matched(matched(ssis.components(found), statements, ["file_name", "task", "name"], "left"), package, "file_name", "left")
    none = F.lit(None).cast("string")
    columns = F.coalesce(F.array_sort(F.map_keys("properties")), F.array().cast("array<string>"))
    return rows.select("file_name", F.col("name").alias("table_name"), F.col("task").alias("schema_name"), "database_name", none.alias("alias"), columns.alias("column_list"), none.alias("joins"), "transformation")


def rows_of(files: DataFrame) -> DataFrame:
    """Rows of files (file_name, text) by their extension: COBOL programs, packages, and scripts for all the rest."""
    from graphloom.extract import sql as S

    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in {".cbl": "program", ".cob": "program", ".cpy": "program", ".dtsx": "package", ".xml": "package"}.items() for x in pair]), suffix_of(F.col("file_name"))), F.lit("script"))
    told = files.withColumn("__kind", kind)
    some = lambda k: told.filter(F.col("__kind") == k).select("file_name", "text")
    scripts = table_rows(S.prepared(some("script"))).drop("pos", "ambiguous").withColumn("transformation", F.lit(None).cast("string"))
    return program_rows(some("program")).unionByName(package_rows(some("package"))).unionByName(scripts)


def extract(rows: DataFrame, template: Template) -> DataFrame:
    """``rows`` in the layout of the template, without repeated rows. What a row does not tell is named unknown."""
    if template.row_per_column:
        rows = rows.withColumn("column", F.explode_outer("column_list"))
    have = {*rows.columns} | {"columns"}

    def value(concept_name: str) -> Column:
        column = _ANSWERS.get(concept_name)
        if column == "columns":
            return F.nullif(F.array_join("column_list", ", "), F.lit(""))
        return F.col(column) if column in have else F.lit(None).cast("string")

    return rows.select(*[F.coalesce(value(c), F.lit(UNKNOWN)).alias(n) for n, c in template.fields]).distinct()


def confidence(rows: DataFrame, ambiguous: Column) -> DataFrame:
    """0 without rows, 0.88 if any row is ambiguous, else 1."""
    return rows.agg(F.when(F.count(F.lit(1)) == 0, 0.0).when(F.max(F.coalesce(ambiguous, F.lit(False))), 0.88).otherwise(1.0).alias("confidence"))

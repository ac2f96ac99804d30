"""Exports, and deletes across all that is kept of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metadata_json(rows: DataFrame, path: str) -> None:
    """One JSON line a file, in a folder a file."""
    rows.write.mode("overwrite").partitionBy("file_name").json(path)


def documents_of(rows: DataFrame, key: str) -> DataFrame:
    """All facts of a key as one JSON array."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.collect_list(F.struct(*rest))).alias("document"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table: bars escaped, line breaks as spaces; the head is ``markdown_head``."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" "))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'|'.join('---' for _ in columns)}|"


def ddl(table: str, columns: list[str]) -> str:
    """A table definition for an extraction's columns."""
    body = ",\n".join(f"    [{c}] NVARCHAR(255) NULL" for c in columns) or "    [id] INT IDENTITY"
    return f"CREATE TABLE [{table}] (\n{body}\n);"


def summary_markdown(purpose: Column, narrative: Column, rules: Column) -> Column:
    """A summary as Markdown."""
    items = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("## Purpose\n"), purpose), narrative, F.when(F.size(rules) > 0, F.concat(F.lit("## Business rules\n"), items)))


def last_points(points: DataFrame, key: str, order: str) -> DataFrame:
    """The later of points with one id replaces the earlier."""
    return points.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def without_file(nodes: DataFrame, edges: DataFrame, points: DataFrame, file_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph and points without what belongs to a file; edges of nodes that go, go too."""
    gone = F.coalesce(F.col("source_file") == file_name, F.lit(False)) | F.col("id").contains(file_name)
    kept = nodes.filter(~gone)
    lost = nodes.filter(gone).select("id")
    left = edges.join(lost, F.col("src") == F.col("id"), "left_anti").join(lost, F.col("dst") == F.col("id"), "left_anti")
    return kept, left, points.filter(F.coalesce(F.col("file_name") != file_name, F.lit(True)))


def last_lines(log: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """The last lines of a log, without those that say nothing."""
    said = log.filter(F.trim("line") != "")
    return said.orderBy(F.desc(order)).limit(most)

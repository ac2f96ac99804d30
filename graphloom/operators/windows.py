"""Window-like operators over lines and ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import strip


#: Parts of a table of files for each core.
PARTS = 4


def dealt(files: DataFrame, parts: int = PARTS) -> DataFrame:
    """``files`` (or rows of files) dealt out by name over all cores, ``parts`` for each.

    What a file holds is many times its size: cut after it is dealt out, its lines and tokens go through windows, groups and joins by
    file without a shuffle, in parts that fit into memory, however few parts the files were read from.
    """
    return files.repartition(parts * files.sparkSession.sparkContext.defaultParallelism, "file_name")


def matched(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``others`` of the same files; neither is sent whole to the driver and to every task.

    What is cut out of files grows with them, but Spark takes its size from the table that the files were read or made from, many times
    too small. So it is told to sort and merge; rows that are dealt out by file already stay where they are.
    """
    return rows.join(others.hint("merge"), on, how)


def line_windows(files: DataFrame, key: str, text: str, size: int = 50, overlap: int = 10) -> DataFrame:
    """Overlapping windows of lines: key, chunk_index, line_start, line_end, text. Blank windows are left out, their numbers too.

    A window begins every ``size - overlap`` lines, until one reaches the end.
    """
    step = size - overlap
    lines = files.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines")).withColumn("n", F.size("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), lambda i: (i == 0) | (i + overlap < F.col("n")))
    cut = lines.select(key, "lines", "n", F.posexplode(starts).alias("chunk_index", "at"))
    body = strip(F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n"))
    return cut.select(key, "chunk_index", (F.col("at") + 1).alias("line_start"), F.least(F.col("at") + size, F.col("n")).alias("line_end"), body.alias("text")).filter("text <> ''")


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, line_number from 1, line."""
    at = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("at", "line")
    return files.select(key, at).select(key, (F.col("at") + 1).alias("line_number"), "line")


def extents(headers: DataFrame, key: str, start: str, end_of_all: Column) -> DataFrame:
    """``headers`` with end: the place before the next header of the same key, or ``end_of_all``."""
    following = F.lead(start).over(W.partitionBy(key).orderBy(start)) - 1
    return headers.withColumn("end", F.coalesce(following, end_of_all))


def carried_forward(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that was not null up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def nesting(tokens: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """``tokens`` with depth: 0 for the outermost opening token and for the closing token that ends it."""
    run = F.sum(F.when(opens, 1).otherwise(-1)).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return tokens.withColumn("depth", F.when(opens, run - 1).otherwise(run).cast("int"))


def first_of_each(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")

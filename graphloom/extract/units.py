"""Units of COBOL programs - paragraphs with their exact place in the text - and the evidence that belongs to each of them.

A program (file_name, text) is one row. Null or empty texts have no lines, and no units; so have programs without a PROCEDURE DIVISION.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.extract import cobol
from graphloom.extract.cobol_lines import NOT_UNITS, UNITS, unit_batches
from graphloom.operators.joins import contained
from graphloom.operators.windows import dealt, matched
from graphloom.session import settled

__all__ = ["NOT_UNITS"]

#: A line with its end, which may be of any of three kinds; the last one may have none.
_LINE = r"[^\r\n]*+(?:\r\n|\n|\r)|[^\r\n]++"


def line_places(files: DataFrame) -> DataFrame:
    """Lines with their ends: (file_name, line, raw, start_offset, start_byte), from 1 and from 0; bytes are those of UTF-8.

    One running sum of widths tells the bytes of all places, whatever their number.
    """
    cut = files.select("file_name", F.posexplode(F.regexp_extract_all("text", F.lit(_LINE), F.lit(0))).alias("at", "raw"))
    before = W.partitionBy("file_name").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f("raw").cast("long")).over(before), F.lit(0)).alias(name) for f, name in ((F.length, "start_offset"), (F.octet_length, "start_byte"))]
    return cut.select("file_name", (F.col("at") + 1).alias("line"), "raw", *sums)


def byte_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """Places (file_name, place: characters before it) with ``byte``, the bytes before it: an as-of join with the lines, in one shuffle.

    A place behind the end is the end. Places before the start, and those in a file without text, have none.
    """
    lines = line_places(files).select("file_name", F.col("start_offset").alias("place"), F.struct("start_offset", "start_byte", "raw").alias("at"))
    asked = places.select("file_name", F.col("place").cast("long").alias("place"), F.lit(None).cast(lines.schema["at"].dataType).alias("at"))
    upto = W.partitionBy("file_name").orderBy("place", F.col("at").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = lines.unionByName(asked).withColumn("line", F.last("at", ignorenulls=True).over(upto)).filter("at IS NULL")
    inside = F.octet_length(F.substring("line.raw", F.lit(1), (F.col("place") - F.col("line.start_offset")).cast("int")))
    return both.select("file_name", "place", (F.col("line.start_byte") + inside).alias("byte"))


def units(files: DataFrame) -> DataFrame:
    """Paragraphs after the first line that says PROCEDURE DIVISION: (file_name, unit_no, unit, start and end line, offset and byte, text).

    A paragraph reaches up to the next one; its lines count up to there, its text and places are without white space at either end.
    """
    return dealt(files.select("file_name", "text")).mapInArrow(unit_batches, UNITS)


def relations_of(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Links of a program, paragraphs that it holds among them, by the units (file_name, unit_no, unit) of that program that are either end, in any case."""
    held = cobol.paragraphs(lines).select("file_name", F.col("file_name").alias("source"), F.lit("CONTAINS_PARAGRAPH").alias("type"), F.col("paragraph").alias("target"))
    all_links = cobol.links(lines).unionByName(held).distinct()
    ends = all_links.withColumn("unit", F.explode(F.array_distinct(F.array(F.upper("source"), F.upper("target")))))
    return matched(ends, found.select("file_name", "unit_no", "unit"), ["file_name", "unit"])


def unit_evidence(files: DataFrame) -> DataFrame:
    """``units`` with ``unit_counts`` and ``operations`` (start, end, op, text) inside their lines, ``relations`` that name them, and the
    ``file_counts`` of the whole program.

    Statements go to units by the places of both alone: an interval join on the program and on cells of lines. One that no unit
    contains is counted for the program only.
    """
    lines = settled(cobol.program_lines(files), "program-lines")  # read for each kind of evidence
    found = units(files)
    operations = cobol.operations(lines)
    extents = found.select("file_name", "unit_no", F.col("start_line").alias("unit_start"), F.col("end_line").alias("unit_end"))
    inside = contained(operations, extents, "file_name")
    counts = lambda rows, keys, name: rows.groupBy(*keys, "op").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias(name))
    own = ["file_name", "unit_no"]
    details = inside.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("start", "end", "op", "text"))).alias("operations"))
    relations = relations_of(lines, found).groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("source", "type", "target"))).alias("relations"))
    full = matched(matched(matched(found, counts(inside, own, "unit_counts"), own, "left"), details, own, "left"), relations, own, "left")
    full = matched(full, counts(operations, ["file_name"], "file_counts"), "file_name", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(full.schema[c].dataType))
    return full.withColumns({"operations": empty("operations"), "relations": empty("relations")})

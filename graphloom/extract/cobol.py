"""Facts of COBOL programs in fixed format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.extract.cobol_lines import LINES, NOT_PARAGRAPHS, OPERATIONS, STATEMENTS, line_batches
from graphloom.functions.text import collapse
from graphloom.operators.windows import dealt, first_of_each, matched

__all__ = ["NOT_PARAGRAPHS", "OPERATIONS", "STATEMENTS"]


def program_lines(files: DataFrame) -> DataFrame:
    """Lines with the division and section they stand in and their first word; comments in column 7 have none.

    Programs are dealt out, however few parts they were read from; ``cobol_lines`` walks over each where it lies. The first line of a paragraph, of an operation and of statements tells their
    end and text; a data item its level, name and record.
    """
    code = F.when(F.substring("raw", 7, 1) == "*", "").otherwise(F.col("raw"))
    return dealt(files.select("file_name", "text")).mapInArrow(line_batches, LINES).withColumn("code", code)


def divisions(lines: DataFrame) -> DataFrame:
    return first_of_each(lines.filter("opens_division"), ["file_name", "division"], "line").select("file_name", "division", "line")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of the PROCEDURE division with their lines: a name alone in area A, up to the next."""
    return lines.filter("paragraph IS NOT NULL").select("file_name", "paragraph", F.col("line").alias("start"), F.col("paragraph_end").alias("end"))


def operations(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """Statements of ten kinds, one that begins a line: op, text, start and end line.

    OPEN and CLOSE take the lines that follow, up to a statement, a paragraph or a line with a full stop. With ``legacy`` a
    line that is a name and a full stop alone counts as a paragraph even there, and is lost.
    """
    told = _cut_by_names(lines) if legacy else lines.filter("op IS NOT NULL")
    return told.select("file_name", F.when(F.col("op") == "GO", "goto").otherwise(F.lower("op")).alias("op"), collapse(F.coalesce("op_text", "code")).alias("text"), F.col("line").alias("start"), F.col("op_end").alias("end"))


def _cut_by_names(lines: DataFrame) -> DataFrame:
    """The first lines of operations with what belongs to them, where a name and a full stop end one wherever they stand."""
    starts = F.col("word").isin(*STATEMENTS) | F.col("code").rlike(r"^\s*[A-Za-z0-9][A-Za-z0-9-]*\s*\.$")
    code = lines.filter(F.col("division") == "PROCEDURE").filter(~F.col("opens_division") & (F.trim("code") != "")).select("file_name", "line", "code", "word", starts.alias("starts"))
    upto = W.partitionBy("file_name").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    within = W.partitionBy("file_name", "statement").orderBy("line")
    stopped = F.coalesce(F.max(F.col("code").endswith(".").cast("int")).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    grouped = code.withColumn("statement", F.sum(F.col("starts").cast("int")).over(upto)).withColumns({"stopped": stopped, "op": F.first("word").over(within)})
    kept = grouped.filter(~F.col("stopped") & F.col("op").isin(*OPERATIONS)).filter(F.col("starts") | F.col("op").isin("OPEN", "CLOSE"))
    texts = kept.groupBy("file_name", "statement", "op").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("l"))
    text = F.array_join(F.col("l.code"), " ")
    return texts.select("file_name", "op", text.alias("op_text"), text.alias("code"), F.col("l")[0]["line"].alias("line"), F.element_at("l", -1)["line"].alias("op_end"))


def operation_counts(lines: DataFrame) -> DataFrame:
    kinds = ["goto" if o == "GO" else o.lower() for o in OPERATIONS]
    return operations(lines).groupBy("file_name").pivot("op", kinds).agg(F.count(F.lit(1))).fillna(0)


def copybooks(lines: DataFrame) -> DataFrame:
    name = F.upper(F.regexp_extract("code", r"(?i)^\s*COPY\s+([A-Za-z0-9-]+)", 1))
    return first_of_each(lines.withColumn("copybook", name).filter("copybook <> ''"), ["file_name", "copybook"], "line").select("file_name", "copybook", "line")


def files(lines: DataFrame) -> DataFrame:
    """Files by SELECT with what they are assigned to, then by FD; the first of a name stays."""
    named = lambda p: F.upper(F.regexp_extract("code", p, 1))
    assigned = F.nullif(named(r"(?i)ASSIGN\s+(?:TO\s+)?[\"']?([A-Za-z0-9-]+)"), F.lit(""))
    selects = F.col("word") == "SELECT"
    said = lines.filter(F.col("word").isin("SELECT", "FD")).withColumn("file", F.when(selects, named(r"(?i)^\s*SELECT\s+(?:OPTIONAL\s+)?([A-Za-z0-9-]+)")).otherwise(named(r"(?i)^\s*FD\s+([A-Za-z0-9-]+)")))
    both = said.filter("file <> ''").select("file_name", "file", "line", F.when(selects, assigned).alias("assign"), F.when(selects, 0).otherwise(1).alias("rank"))
    return first_of_each(both, ["file_name", "file"], "rank", "line").drop("rank")


def variables(lines: DataFrame) -> DataFrame:
    """Data items of levels 01 to 49 and 77 with their picture, and the record that each of them stands in."""
    picture = F.nullif(F.upper(F.regexp_extract("code", r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?([^\s]+?)\.?(?:\s|$)", 1)), F.lit(""))
    value = F.nullif(F.regexp_extract("code", r"(?i)\bVALUE\s+(?:IS\s+)?(.+?)\.?$", 1), F.lit(""))
    return lines.filter("level IS NOT NULL").select("file_name", "level", F.col("item").alias("name"), picture.alias("picture"), value.alias("value"), "record", "line")


def records(lines: DataFrame) -> DataFrame:
    """Records - items of level 01 without a picture - with their fields in order."""
    items = variables(lines)
    heads = items.filter("level = '01' AND picture IS NULL").select("file_name", F.col("name").alias("record"), F.col("line").alias("at"))
    fields = items.filter("level <> '01' AND level <> '77' AND picture IS NOT NULL").groupBy("file_name", "record").agg(F.array_sort(F.collect_list(F.struct("line", "name", "picture"))).alias("f"))
    return matched(heads, fields, ["file_name", "record"], "left").select("file_name", "record", F.col("at").alias("line"), F.coalesce(F.col("f.name"), F.array().cast("array<string>")).alias("fields"))


def relationships(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """What a program does to what: (file_name, type, target), a row for each statement that says so.

    With ``legacy`` OPEN names the first file after each mode alone.
    """
    ops = operations(lines, legacy).withColumn("t", F.upper("text"))
    word = lambda p: F.regexp_extract("t", p, 1)
    one = lambda kind, op, p: ops.filter(F.col("op") == op).select("file_name", F.lit(kind).alias("type"), word(p).alias("target"))
    named = [one("READS", "read", r"^READ\s+([A-Z0-9-]+)"), one("WRITES", "write", r"^WRITE\s+([A-Z0-9-]+)")]
    performs = one("PERFORMS", "perform", r"^PERFORM\s+([A-Z0-9-]+)").filter(~F.col("target").isin("UNTIL", "VARYING", "WITH", "TEST"))
    names = lambda p: F.filter(F.split(F.regexp_replace("t", p, " "), r"[\s,.]+"), lambda x: x != "")
    firsts = F.regexp_extract_all("t", F.lit(r"\b(?:INPUT|OUTPUT|I-O|EXTEND)\s+([A-Z0-9-]+)"), F.lit(1))
    opened = firsts if legacy else names(r"^OPEN\b|\b(?:INPUT|OUTPUT|I-O|EXTEND)\b")
    opens = ops.filter("op = 'open'").select("file_name", F.lit("OPENS").alias("type"), F.explode(opened).alias("target"))
    closes = ops.filter("op = 'close'").select("file_name", F.lit("CLOSES").alias("type"), F.explode(names(r"^CLOSE\b")).alias("target"))
    copies = copybooks(lines).select("file_name", F.lit("USES_COPYBOOK").alias("type"), F.col("copybook").alias("target"))
    has = paragraphs(lines).select("file_name", F.lit("CONTAINS_PARAGRAPH").alias("type"), F.col("paragraph").alias("target"))
    record = records(lines).select("file_name", F.lit("CONTAINS_RECORD").alias("type"), F.col("record").alias("target"))
    field = records(lines).select("file_name", F.lit("CONTAINS_FIELD").alias("type"), F.explode("fields").alias("target"))
    return reduce(DataFrame.unionByName, [*named, performs, opens, closes, copies, has, record, field]).filter("target <> ''")


def section_views(lines: DataFrame) -> DataFrame:
    """The lines of a program for three reviews: structure (all before PROCEDURE), behaviour (PROCEDURE), relations."""
    relation = F.col("word").isin("FD", "SELECT", "COPY", "PERFORM", "READ", "WRITE", "REWRITE", "OPEN", "CLOSE", "CALL", "MOVE", "COMPUTE", "ADD", "DISPLAY", "IF")
    view = lambda name, rows: rows.groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("text")).withColumn("view", F.lit(name))
    return view("structural", lines.filter("division <> 'PROCEDURE'")).unionByName(view("behavioral", lines.filter("division = 'PROCEDURE'"))).unionByName(view("relationship", lines.filter(relation)))


def statements(lines: DataFrame) -> DataFrame:
    """All statements of the PROCEDURE division, wherever in a line they begin: (file_name, paragraph, op, text, start, end).

    A statement ends at the next verb, at a full stop or at an END word; words in literals begin none. The paragraph is the last
    one that begins before it.
    """
    return lines.select("file_name", "line", F.explode("statements").alias("s")).select("file_name", "s.paragraph", "s.op", "s.text", F.col("line").alias("start"), "s.end")


def file_records(lines: DataFrame) -> DataFrame:
    """The records of each file: items of level 01 after its FD or SD, up to the next one or the end of the FILE SECTION."""
    record = F.upper(F.regexp_extract("code", r"^\s*01\s+([A-Za-z0-9-]+)", 1))
    return lines.filter("division = 'DATA' AND file <> ''").select("file_name", "file", record.alias("record"), "line").filter("record <> ''")


def links(lines: DataFrame) -> DataFrame:
    """What a program's statements tie together: (file_name, source, type, target), each once.

    WRITE and REWRITE name a record: with the file that it belongs to - or that is called so itself - the program WRITES the file, and
    the file WRITES_RECORD the record; without one the program WRITES what is named. READS names files, CALLS programs or the items
    that hold their names. A paragraph PERFORMS another, with THRU all from the first to the last; it GOES_TO another.
    """
    said = statements(lines).withColumn("t", F.upper("text"))
    name = lambda p: F.regexp_extract("t", p, 1)
    link = lambda source, kind, target: F.struct(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"))
    program, source = F.col("file_name"), F.coalesce("paragraph", "file_name")

    # what a statement says alone
    first, last = name(r"^PERFORM ([A-Z0-9-]+)"), F.nullif(name(r"^PERFORM [A-Z0-9-]+ (?:THRU|THROUGH) ([A-Z0-9-]+)"), F.lit(""))
    performs = (F.col("op") == "perform") & ~first.isin("UNTIL", "VARYING", "WITH", "TEST", "") & ~F.col("t").rlike("^PERFORM [A-Z0-9-]+ TIMES")
    call = F.regexp_replace(name(r"""^CALL ("[^"]*"|'[^']*'|[A-Z0-9-]+)"""), "[\"']", "")
    alone = F.when(F.col("op") == "read", link(program, "READS", name(r"^READ ([A-Z0-9-]+)"))).when(F.col("op") == "call", link(program, "CALLS", call)).when(F.col("op") == "go", link(source, "GOES_TO", name(r"^GO (?:TO )?([A-Z0-9-]+)"))).when(performs & last.isNull(), link(source, "PERFORMS", first))
    plain = said.filter(F.col("op").isin("read", "call", "go", "perform")).select("file_name", alone.alias("l")).filter("l IS NOT NULL").select("file_name", "l.*")

    written = said.filter(F.col("op").isin("write", "rewrite")).select("file_name", name(r"^(?:RE)?WRITE ([A-Z0-9-]+)").alias("record")).distinct()
    owners = file_records(lines).select("file_name", "file", "record").unionByName(files(lines).select("file_name", "file", F.col("file").alias("record"))).dropDuplicates(["file_name", "record"])
    tied = F.array(link(program, "WRITES", F.coalesce("file", "record")), F.when(F.col("file").isNotNull(), link(F.col("file"), "WRITES_RECORD", F.col("record"))))
    writes = matched(written, owners, ["file_name", "record"], "left").select("file_name", F.explode(F.array_compact(tied)).alias("l")).select("file_name", "l.*")

    # from the first to the last of a range of paragraphs, or to both where they are none
    placed = lines.filter("paragraph IS NOT NULL").select("file_name", "paragraph", F.col("paragraph_no").alias("n"))
    at = lambda c, n: placed.select("file_name", F.col("paragraph").alias(c), F.col("n").alias(n))
    ranges = said.filter(performs & last.isNotNull()).select("file_name", source.alias("source"), first.alias("first"), last.alias("last"))
    ranged = matched(matched(ranges, at("first", "a"), ["file_name", "first"], "left"), at("last", "b"), ["file_name", "last"], "left")
    spread = ranged.withColumn("n", F.explode(F.when(F.col("a") <= F.col("b"), F.sequence("a", "b")).otherwise(F.array(F.lit(None).cast("int")))))
    between = matched(spread, placed, ["file_name", "n"], "left").select("file_name", "source", F.lit("PERFORMS").alias("type"), F.explode(F.when(F.col("n").isNull(), F.array("first", "last")).otherwise(F.array("paragraph"))).alias("target"))
    return reduce(DataFrame.unionByName, [plain, writes, between]).filter("target <> ''").distinct()

"""Facts of SQL scripts, read off their tokens.

One pattern cuts a script into tokens and covers every character of it, so running lengths give their places. ``sql_tokens`` tells batch by
batch what stands before and after a token, which brackets, statement and query block it stands in. Extractors keep the few tokens that
they ask for; only those are shuffled. A clause reaches from its keyword to the next one that ends it, found by a running minimum from the end.

With ``legacy`` a clause doesn't end with the brackets it stands in but runs on to the next clause.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.extract.sql_tokens import BEGINNERS, CHANGES, LISTS, SCHEMA, batches
from graphloom.functions.text import collapse, sql_identifier, without_comments
from graphloom.functions.vocabulary import NOT_CASE_ALIASES, NOT_TABLE_ALIASES, SQL_FUNCTIONS
from graphloom.operators.windows import dealt, first_of_each, matched, nesting
from graphloom.session import settled, with_checkpoints

#: Words that no alias is.
_NO_ALIAS = (*NOT_TABLE_ALIASES, *map(str.lower, (*BEGINNERS, *CHANGES)), "select", "set", "begin", "end", "else", "for", "option", "values", "using", "pivot", "unpivot", "tablesample", "output", "window", "qualify", "limit", "offset", "except", "intersect", "as", "when", "then", "apply", "and", "or", "from")
_KINDS = ("INNER", "LEFT", "RIGHT", "FULL", "CROSS")


def prepared(files: DataFrame) -> DataFrame:
    """``files`` (file_name, text) without a byte-order mark and without comments; line numbers stay."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    return dealt(files.select("file_name", "text")).select("file_name", without_comments(text).alias("text"))


def tokens(sql: DataFrame) -> DataFrame:
    """The tokens of each script but white space: place, line, upper case, the words before and after, brackets, block, statement and clause.

    ``level`` and ``pair`` name the brackets: how deep they are, and the how-manieth of that depth. Both brackets stand in their pair;
    ``opener`` is the word before it, ``closed1`` and ``closed2`` (of the opening one) follow it. ``block`` is the CASE or BEGIN that a
    token stands in, begins or ends, ``case_depth`` how many CASE there are around it, from 0. ``statement`` counts the statements of the
    script, which need no semicolons; ``until`` is where a statement ends, ``first`` its first word, ``changed`` what it changes.

    ``depth`` and ``query`` name the pair of brackets around the innermost sub-query, ``part`` the how-manieth SELECT of it or of the
    statement (0 before the first), ``scope`` the place where that block begins, ``scope_no`` its number, ``base`` its level; ``read``
    tells what a FROM or JOIN reads. The first token of a block has the extent of the block, its parent, and the words that open it.
    """
    return sql.select("file_name", "text").mapInArrow(batches, SCHEMA)


def _is_name(c: str) -> Column:
    return F.col(c).rlike(r"^[\[\"#A-Za-z_]") & ~F.col(c).rlike(r"^[Nn]'")


def _alias(reserved: tuple[str, ...]) -> Column:
    """The name that follows a token, with or without AS, if it is one plain word and none of the reserved."""
    word = F.when(F.upper("after1") == "AS", F.col("after2")).otherwise(F.col("after1"))
    bare = sql_identifier(word)
    return F.when(bare.rlike(r"^[A-Za-z_]\w*$") & ~F.lower(bare).isin(*reserved), bare)


def _starts_join() -> Column:
    before = F.coalesce("before1", F.lit(""))
    alone = (F.col("word") == "JOIN") & ~before.isin(*_KINDS, "OUTER")
    return alone | (F.col("word").isin(*_KINDS) & ((F.upper("after1") == "JOIN") | ((F.upper("after1") == "OUTER") & (F.upper("after2") == "JOIN"))))


def _starts(*clauses: str) -> Column:
    """Whether a token begins one of the clauses, named by their first words."""
    by = F.col("word").isin("GROUP", "ORDER")
    return F.coalesce(F.col("word").isin(*clauses) & (~by | (F.upper("after1") == "BY")), F.lit(False))


def _until(words: DataFrame, wanted: Column, ends: Column, legacy: bool) -> DataFrame:
    """The ``wanted`` tokens with stop: where the next token that ``ends`` a clause begins, or the brackets or the statement do; with ``legacy`` null at the end of the script."""
    keys = ["file_name"] if legacy else ["file_name", "statement", "level", "pair"]
    some = words.withColumns({"wanted": F.coalesce(wanted, F.lit(False)), "ends": F.coalesce(ends, F.lit(False))}).filter(F.col("wanted") | F.col("ends") | F.col("word").isin(")", "ON"))
    later = W.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    closed = F.lit(None) if legacy else F.coalesce(F.max(F.when(F.col("token") == ")", F.col("start"))).over(W.partitionBy(*keys)), F.col("until"))
    found = some.withColumns({"stop": F.coalesce(F.min(F.when(F.col("ends"), F.col("start"))).over(later), closed), "on_end": F.min(F.when(F.col("word") == "ON", F.col("end"))).over(later)})
    return found.filter("wanted").drop("wanted", "ends")


def _cut(rows: DataFrame, sql: DataFrame, begin: str, stop: str, name: str) -> DataFrame:
    """``rows`` with the text of their script between two places; a null ``stop`` is its end."""
    text = sql.select("file_name", "text")
    length = F.coalesce(F.col(stop), F.length("text")) - F.col(begin)
    return matched(rows, text, "file_name").withColumn(name, collapse(F.substring("text", F.col(begin) + 1, length))).drop("text")


def _rest_of_line(rows: DataFrame, sql: DataFrame, begin: str, stop: str, name: str) -> DataFrame:
    """``rows`` with what stands between two places, at most to the end of the line or a semicolon."""
    part = F.substring("text", F.col(begin) + 1, F.coalesce(F.col(stop), F.length("text")) - F.col(begin))
    rest = F.regexp_substr(part, F.lit(r"^[^\n;]*+"))
    return matched(rows, sql.select("file_name", "text"), "file_name").withColumn(name, F.coalesce(rest, F.lit(""))).drop("text")


def variables(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Variables of DECLARE, one or several in a list."""
    listed = (F.col("token") == ",") & F.col("after1").startswith("@")
    wanted = (F.col("first") == "DECLARE") & (F.col("level") == 0) & F.col("before1").isin("DECLARE", ",") & F.col("token").startswith("@")
    declared = _until(tokens(sql) if words is None else words, wanted, listed | (F.col("token") == ";"), False)
    told = _rest_of_line(declared, sql, "end", "stop", "rest")
    kind = F.regexp_extract(F.substring_index("rest", "=", 1), r"(?i)^\s*(?:AS\s)?\s*(\w+(?:\s*\([^)]*\))?)", 1)
    default = F.when(F.col("rest").contains("="), F.substring("rest", F.instr("rest", "=") + 1, F.length("rest")))
    return told.select("file_name", F.col("token").alias("name"), collapse(kind).alias("datatype"), collapse(default).alias("default_value"), "line")


def set_statements(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Values that SET gives to variables; ``SET @a += b`` gives ``@a + b``."""
    words = tokens(sql) if words is None else words
    told = words.filter((F.col("before1") == "SET") & F.col("token").startswith("@") & F.col("after1").rlike(r"^[-+*/%&|^]?=$"))
    value = collapse(F.col("rest"))
    full = F.when(F.col("after1") == "=", value).otherwise(F.concat_ws(" ", "token", F.substring("after1", 1, 1), value))
    return _rest_of_line(told, sql, "next_end", "until", "rest").select("file_name", F.col("token").alias("variable"), full.alias("value"), "line")


def tables(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Tables that are read: after FROM or JOIN, or after a comma of their list."""
    found = (tokens(sql) if words is None else words).filter(F.col("read") & _is_name("token"))
    source = F.when(F.col("before1") == "JOIN", "JOIN").otherwise("FROM")
    return found.select("file_name", "pos", source.alias("source"), sql_identifier(F.col("token")).alias("table"), _alias(_NO_ALIAS).alias("alias"), "line")


#: Words that begin clauses of expressions.
_EXPRESSIONS = ("SELECT", "ON", "WHERE", "GROUP", "HAVING", "ORDER", "SET")


def unique_tables(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Tables of a file in any case, as they are spelled first."""
    named = tables(sql, words).withColumn("key", F.lower("table"))
    return first_of_each(named, ["file_name", "key"], "pos").select("file_name", "table", "pos")


def joins(sql: DataFrame, legacy: bool = False, words: DataFrame | None = None) -> DataFrame:
    """Joins that have an ON, with their condition."""
    ends = F.coalesce(_starts_join(), F.lit(False)) | _starts("WHERE", "GROUP", "HAVING", "ORDER", "UNION", ";")
    if not legacy:
        ends = ends | (F.col("token") == ",")
    found = _until(tokens(sql) if words is None else words, (F.col("before1") == "JOIN") & _is_name("token"), ends, legacy)
    found = found.filter(F.col("on_end") < F.coalesce("stop", F.lit(2**31 - 1)))
    outer = F.col("before2") == "OUTER"
    kind = F.concat_ws(" ", F.when(outer & F.col("before3").isin(*_KINDS), F.col("before3")), F.when(F.col("before2").isin(*_KINDS, "OUTER"), F.col("before2")), F.lit("JOIN"))
    return _cut(found, sql, "on_end", "stop", "condition").select("file_name", kind.alias("join_type"), sql_identifier(F.col("token")).alias("table"), _alias(_NO_ALIAS).alias("alias"), "condition", "line")


def cases(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """CASE expressions with their level and their number among those of it: each END closes the latest CASE of its level."""
    words = tokens(sql) if words is None else words
    ends = words.filter(F.col("word").isin("CASE", "END") & (F.col("block") == "CASE")).withColumn("opens", F.col("word") == "CASE")
    by = W.partitionBy("file_name", "depth").orderBy("pos")
    levelled = nesting(ends, "file_name", "pos", F.col("opens")).filter("depth >= 0")
    numbered = levelled.withColumn("number", F.sum(F.col("opens").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    paired = numbered.withColumns({"from": F.lag("start").over(by), "from_line": F.lag("line").over(by), "was_open": F.lag("opens").over(by)}).filter("NOT opens AND was_open")
    told = _cut(paired, sql, "from", "end", "expression")
    return told.select("file_name", _alias(NOT_CASE_ALIASES).alias("target_column"), "expression", F.col("from_line").alias("line"), (F.col("depth") > 0).alias("nested"), F.col("depth").alias("nesting_level"), "number")


def business_rules(sql: DataFrame, legacy: bool = False, words: DataFrame | None = None) -> DataFrame:
    """WHEN branches as rules. Each CASE gives its own, in which an inner one is "(CASE)".

    With ``legacy`` the branches of inner ones count as branches of the outermost, one after another.
    """
    every = tokens(sql) if words is None else words
    words = every.filter("case_depth >= 0").select("file_name", "pos", "token", "word", "spaced", F.col("case_depth").alias("depth"))
    if legacy:
        words = words.withColumn("outer", (F.col("word") == "CASE") & (F.col("depth") == 0)).withColumn("depth", F.lit(0))
    else:
        inner = words.filter("word = 'CASE' AND depth > 0").withColumns({"token": F.lit("(CASE)"), "word": F.lit(None).cast("string"), "depth": F.col("depth") - 1})
        words = words.unionByName(inner).withColumn("outer", F.coalesce(F.col("word") == "CASE", F.lit(False)))
    by = W.partitionBy("file_name", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    mark = F.col("word").isin("WHEN", "THEN", "ELSE", "END") | ((F.col("word") == "CASE") & F.col("outer"))
    told = words.withColumns({"number": F.sum(F.col("outer").cast("int")).over(by), "mark": F.coalesce(mark, F.lit(False))})
    by = W.partitionBy("file_name", "depth", "number").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    told = told.withColumns({"branch": F.sum((F.col("mark") & (F.col("word") == "WHEN")).cast("int")).over(by), "part": F.last(F.when(F.col("mark"), F.col("word")), ignorenulls=True).over(by)})
    pieces = told.filter("NOT mark AND branch > 0 AND part IN ('WHEN', 'THEN')").select("file_name", "depth", "number", "branch", F.struct("pos", "part", F.concat(F.when(F.col("spaced"), " ").otherwise(""), "token").alias("piece")).alias("p"))
    listed = pieces.groupBy("file_name", "depth", "number", "branch").agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = lambda part: collapse(F.array_join(F.transform(F.filter("p", lambda x: x["part"] == part), lambda x: x["piece"]), ""))
    rules = listed.select("file_name", F.col("depth").alias("nesting_level"), "number", text("WHEN").alias("condition"), text("THEN").alias("result")).filter("condition IS NOT NULL AND result IS NOT NULL")
    if not legacy:
        # CASE x WHEN 1: what stands before the first WHEN is compared with each
        first = told.filter("NOT mark AND branch = 0 AND part = 'CASE'").groupBy("file_name", F.col("depth").alias("nesting_level"), "number").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.when(F.col("spaced"), " ").otherwise(""), "token").alias("piece")))).alias("p"))
        operand = first.select("file_name", "nesting_level", "number", collapse(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("operand"))
        rules = matched(rules, operand, ["file_name", "nesting_level", "number"], "left").withColumn("condition", F.concat(F.coalesce(F.concat("operand", F.lit(" = ")), F.lit("")), "condition")).drop("operand")
    rule = F.concat(F.lit("IF "), F.col("condition"), F.lit(" THEN "), F.coalesce("target_column", F.lit("CASE_RESULT")), F.lit(" = "), F.col("result"))
    return matched(rules, cases(sql, every), ["file_name", "nesting_level", "number"]).select("file_name", "target_column", "condition", "result", rule.alias("rule"), "line")


def where_conditions(sql: DataFrame, legacy: bool = False, words: DataFrame | None = None) -> DataFrame:
    found = _until(tokens(sql) if words is None else words, F.col("word") == "WHERE", _starts("GROUP", "HAVING", "ORDER", "UNION", ";"), legacy)
    return _cut(found, sql, "end", "stop", "condition").select("file_name", "condition", "line")


def group_by(sql: DataFrame, legacy: bool = False, words: DataFrame | None = None) -> DataFrame:
    found = _until(tokens(sql) if words is None else words, (F.col("word") == "GROUP") & (F.upper("after1") == "BY"), _starts("HAVING", "ORDER", "UNION", ";"), legacy)
    return _cut(found, sql, "next_end", "stop", "columns").select("file_name", "columns", "line")


def functions(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The known functions that a script calls, by name."""
    called = (tokens(sql) if words is None else words).filter(F.col("word").isin(*SQL_FUNCTIONS) & (F.col("after1") == "(")).groupBy("file_name").agg(F.array_sort(F.collect_set("word")).alias("functions"))
    return matched(sql.select("file_name"), called, "file_name", "left").withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))


def column_references(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Two plain names with a dot between, in any case, as they are spelled first."""
    two = F.regexp_extract_all("token", F.lit(r"(?:^|\.)\s*([A-Za-z_]\w*\s*\.\s*[A-Za-z_]\w*)"), F.lit(1))
    found = (tokens(sql) if words is None else words).filter(_is_name("token") & F.col("token").contains(".")).select("file_name", "pos", F.posexplode(two).alias("nth", "two"))
    named = found.withColumn("reference", sql_identifier(F.col("two"))).withColumns({"alias": F.substring_index("reference", ".", 1), "column": F.substring_index("reference", ".", -1)})
    keyed = named.withColumns({"a": F.lower("alias"), "c": F.lower("column")})
    return first_of_each(keyed, ["file_name", "a", "c"], "pos", "nth").select("file_name", "alias", "column", "reference")


def structure(sql: DataFrame) -> DataFrame:
    """What the statements of a script are made of: (file_name, kind, name, alias, line).

    Kinds: select, cte, derived_table, and the tables that are read (table, or cte_reference), inserted into, updated, deleted from,
    merged into or made (insert, update, delete, merge, into).
    """
    seen = tokens(sql)
    name, b1, b2 = _is_name("token"), F.coalesce("before1", F.lit("")), F.coalesce("before2", F.lit(""))
    kind = (
        F.when(F.col("word") == "SELECT", "select")
        .when(name & b1.isin("WITH", ",") & (F.upper("after1") == "AS") & (F.col("after2") == "("), "cte")
        .when((F.col("token") == "(") & b1.isin("FROM", "JOIN", "APPLY"), "derived_table")
        .when(name & ((b1 == "INSERT") & (F.col("word") != "INTO") | (b1 == "INTO") & (b2 == "INSERT")), "insert")
        .when(name & ((b1 == "MERGE") & (F.col("word") != "INTO") | (b1 == "INTO") & (b2 == "MERGE")), "merge")
        .when(name & (b1 == "INTO"), "into")
        .when(name & (b1 == "UPDATE"), "update")
        .when(name & (b1 == "FROM") & (b2 == "DELETE"), "delete")
        .when(name & b1.isin("FROM", "JOIN"), "table")
    )
    named = F.when(kind.isin("select", "derived_table"), F.lit(None)).otherwise(sql_identifier(F.col("token")))
    after_pair = sql_identifier(F.when(F.upper("closed1") == "AS", F.col("closed2")).otherwise(F.col("closed1")))
    alias = F.when(kind == "derived_table", F.when(after_pair.rlike(r"^[A-Za-z_]\w*$") & ~F.lower(after_pair).isin(*_NO_ALIAS), after_pair)).when(kind == "table", _alias(_NO_ALIAS))
    rows = seen.select("file_name", "pos", kind.alias("kind"), named.alias("name"), alias.alias("alias"), "line").filter("kind IS NOT NULL")
    ctes = rows.filter("kind = 'cte'").select("file_name", F.lower("name").alias("key"), F.lit(True).alias("cte")).distinct()
    told = matched(rows.withColumn("key", F.lower("name")), ctes, ["file_name", "key"], "left")
    return told.select("file_name", F.when((F.col("kind") == "table") & F.col("cte").isNotNull(), "cte_reference").otherwise(F.col("kind")).alias("kind"), "name", "alias", "line")


#: Words of expressions that name no column, and functions whose first argument names a part of a date or a type.
_KEYWORDS = """SELECT DISTINCT ALL TOP PERCENT TIES FROM WHERE AND OR NOT NULL IS IN EXISTS ANY SOME BETWEEN LIKE ESCAPE CASE WHEN THEN ELSE END AS ON JOIN INNER LEFT RIGHT FULL OUTER CROSS APPLY
GROUP BY HAVING ORDER ASC DESC UNION EXCEPT INTERSECT INTO INSERT UPDATE DELETE MERGE SET VALUES DEFAULT WITH OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW OFFSET FETCH NEXT ONLY
FIRST FOR XML PATH OPTION COLLATE AT TIME ZONE TRUE FALSE ROLLUP CUBE GROUPING SETS NOLOCK MATCHED OUTPUT USING IF BEGIN GO CURRENT_TIMESTAMP CURRENT_USER SESSION_USER SYSTEM_USER""".split()
_DATE_PARTS_OF = ("DATEADD", "DATEDIFF", "DATEDIFF_BIG", "DATEPART", "DATENAME", "DATETRUNC", "CONVERT", "TRY_CONVERT")


def _operand_before() -> Column:
    """Whether the token before ends an operand, so that a name here can only be an alias."""
    b1, b2 = F.coalesce("before1", F.lit("")), F.coalesce("before2", F.lit(""))
    name = b1.rlike(r"^[\[\"#A-Z_@0-9]") & ~b1.isin(*_KEYWORDS) & ~((b2 == "TOP") & b1.rlike(r"^[0-9]"))
    return name | b1.rlike(r"^N?'") | (b1 == "END") | ((b1 == ")") & ~F.coalesce(F.col("closed_opener") == "TOP", F.lit(False)))


def scopes(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The query blocks of a script: (file_name, scope, parent, statement, kind, name, line, end_line, text).

    Scopes are numbered as they begin. Kinds: statement (what stands before its first SELECT), select, union, cte, derived, subquery.
    A cte or derived table has its name; the parent is the block around its brackets. Statements need no semicolons.
    """
    seen = _scope_rows(tokens(sql) if words is None else words)
    return _cut(seen, sql, "from", "to", "part").withColumnRenamed("part", "text").select("file_name", "scope", "parent", "statement", "kind", "name", "line", "end_line", "text")


def _scope_rows(words: DataFrame) -> DataFrame:
    derived = F.col("o_before1").isin("FROM", "JOIN", "APPLY") | ((F.col("o_before1") == ",") & F.col("o_clause").isin(*LISTS))
    kind = F.when(F.col("opened"), F.when((F.col("o_before1") == "AS") & (F.col("o_clause") == "OTHER") & F.col("o_cte").isNotNull(), "cte").when(derived, "derived").otherwise("subquery"))
    after = sql_identifier(F.when(F.upper("o_closed1") == "AS", F.col("o_closed2")).otherwise(F.col("o_closed1")))
    # the name of a common table expression is the last one that begins it before its brackets
    name = F.when(kind == "cte", sql_identifier(F.col("o_cte"))).when(kind == "derived", F.when(after.rlike(r"^[A-Za-z_]\w*$") & ~F.lower(after).isin(*_NO_ALIAS), after))
    union = F.col("s_before1").isin("UNION", "EXCEPT", "INTERSECT") | ((F.col("s_before1") == "ALL") & (F.col("s_before2") == "UNION"))
    what = F.when(F.col("part") == 0, "statement").when(F.coalesce(union, F.lit(False)), "union").when(F.col("depth") == 0, "select").otherwise(kind)
    begins = words.filter("pos = scope")
    return begins.select("file_name", F.col("pos").alias("at"), F.col("scope_no").alias("scope"), "parent", "statement", "depth", what.alias("kind"), F.when(F.col("depth") > 0, name).alias("name"), F.col("start").alias("from"), F.col("scope_to").alias("to"), "line", F.col("scope_end_line").alias("end_line"))


def _is_target() -> Column:
    """Whether a name is what a statement changes."""
    b1, b2 = F.coalesce("before1", F.lit("")), F.coalesce("before2", F.lit(""))
    into = (b1 == "INTO") & b2.isin("INSERT", "MERGE")
    return into | (b1.isin("UPDATE", "MERGE") & ~F.col("word").isin("INTO", "TOP", "SET")) | ((b1 == "INSERT") & (F.col("word") != "INTO")) | ((b1 == "DELETE") & ~F.col("word").isin("FROM", "TOP"))


def _sources(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """What each scope reads or changes: (file_name, scope, pos, name, alias, kind), kinds table, cte, derived, target."""
    target = _is_target() & ~F.col("read")
    names = words.filter(_is_name("token") & (F.col("read") | (F.col("base") == F.col("level")) & (target | F.col("before1").isin("USING", "APPLY") & (F.coalesce("after1", F.lit("")) != "("))))
    told = names.select("file_name", F.col("scope_no").alias("scope"), "pos", "statement", sql_identifier(F.col("token")).alias("name"), _alias(_NO_ALIAS).alias("alias"), F.when(target, "target").otherwise("table").alias("kind"))
    ctes = blocks.filter("kind = 'cte'").groupBy("file_name", "statement", F.lower("name").alias("key")).agg(F.min("at").alias("cte_at"))
    told = matched(told.withColumn("key", F.lower("name")), ctes, ["file_name", "statement", "key"], "left")
    told = told.withColumn("kind", F.when((F.col("kind") == "table") & (F.col("cte_at") < F.col("pos")), "cte").otherwise(F.col("kind")))
    made = blocks.filter("kind = 'derived' AND parent IS NOT NULL").select("file_name", F.col("parent").alias("scope"), F.col("at").alias("pos"), "name", F.col("name").alias("alias"), F.lit("derived").alias("kind"))
    every = told.select("file_name", "scope", "pos", "name", "alias", "kind").unionByName(made)
    # UPDATE a ... FROM t a, DELETE t FROM t: what is changed is one of the sources that are read, not one more
    read = every.filter("kind <> 'target'")
    called = read.select("file_name", "scope", F.explode(F.array_compact(F.array(F.lower("alias"), F.lower("name")))).alias("key"), F.lit(True).alias("again")).distinct()
    return matched(every.withColumn("key", F.lower("name")), called, ["file_name", "scope", "key"], "left").filter("kind <> 'target' OR again IS NULL").drop("key", "again")


def _mentions(words: DataFrame) -> DataFrame:
    """Names in expressions that can only be columns: (file_name, s, pos, qualifier, column, key), s the scope, qualifier null for a plain name.

    ``key`` is the qualifier, or the target for columns that the statement sets or lists.
    """
    a1, b1 = F.coalesce("after1", F.lit("")), F.coalesce("before1", F.lit(""))
    own = F.col("level") == F.col("base")
    seen = words.withColumn("changed", F.lower(F.substring_index(sql_identifier(F.col("changed")), ".", -1)))
    assigned = (F.col("clause") == "SELECT") & own & b1.isin("SELECT", ",", "DISTINCT") & (a1 == "=")
    alias = (F.col("clause") == "SELECT") & own & _operand_before() | assigned
    argument = (b1 == "(") & F.coalesce(F.col("opener").isin(*_DATE_PARTS_OF), F.lit(False))
    listed = F.col("clause").isin("INTO", "INSERT") & ~own
    dotted = F.col("token").contains(".")
    place = F.col("clause").isin(*_EXPRESSIONS) | listed | (F.col("clause") == "VALUES") & dotted
    fits = place & _is_name("token") & ~F.col("read") & (a1 != "(") & ~b1.isin("AS", "COLLATE", ".") & ~F.col("word").isin(*_KEYWORDS)
    bare = sql_identifier(F.col("token"))
    named = seen.withColumn("is_alias", F.coalesce(fits & ~dotted & alias, F.lit(False)))
    star = (a1 == ".") & (F.col("after2") == "*")
    full = F.when(star, F.concat(bare, F.lit(".*"))).otherwise(bare)
    some = named.filter(fits & ~F.col("is_alias") & (dotted | star | (~argument & (a1 != "."))))
    parts = F.split(full, r"\.")
    qualifier = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    sets = listed | ((F.col("clause") == "SET") & own & b1.isin("SET", ",") & (a1 == "="))
    mentions = some.select("file_name", F.col("scope_no").alias("s"), "pos", "clause", qualifier.alias("qualifier"), F.element_at(parts, -1).alias("column"), F.coalesce(F.lower(qualifier), F.when(sets, F.col("changed"))).alias("key"))
    # ORDER BY may name what the select list calls something
    order_as = named.filter((F.col("clause") == "SELECT") & (F.col("is_alias") | (b1 == "AS") & _is_name("token"))).select("file_name", F.col("scope_no").alias("s"), F.lower(bare).alias("shown"), F.lit(True).alias("called")).distinct()
    return matched(mentions.withColumn("shown", F.lower("column")), order_as, ["file_name", "s", "shown"], "left").filter("qualifier IS NOT NULL OR clause <> 'ORDER' OR called IS NULL").drop("shown", "called", "clause")


def _reaches(blocks: DataFrame) -> DataFrame:
    """(file_name, s, above, steps): each scope with itself and all around it, squared as often as the deepest nesting asks for."""
    deepest = blocks.agg(F.max("depth")).first()[0] or 0
    own, around = F.struct(F.col("scope").alias("above"), F.lit(0).alias("steps")), F.struct(F.col("parent").alias("above"), F.lit(1).alias("steps"))
    reach = blocks.select("file_name", F.col("scope").alias("s"), F.explode(F.array(own, around)).alias("x")).select("file_name", "s", "x.above", "x.steps").filter("above IS NOT NULL")
    known = 1
    while known < deepest:
        further = reach.select("file_name", F.col("s").alias("above"), F.col("above").alias("top"), F.col("steps").alias("more"))
        reach = matched(reach, further, ["file_name", "above"]).select("file_name", "s", F.col("top").alias("above"), (F.col("steps") + F.col("more")).alias("steps")).distinct().checkpoint()
        known *= 2
    return reach


def column_owners(sql: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Whose column each name in an expression is: (file_name, scope, qualifier, column, owner, owner_kind, status, candidates, pos).

    A qualified column belongs to the nearest scope, from its own outwards, that has a source of that name or alias; what a statement
    sets or lists belongs to its target. Any other plain one belongs to the only source of the nearest scope that has any; if that has
    several it is ambiguous, without one unknown. ``candidates`` are the places of the sources that it may belong to.
    """
    return resolved(sql, words)[1]


def resolved(sql: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources (file_name, scope, pos, name, alias, kind) of all query blocks, and the owners of columns."""
    with_checkpoints(sql.sparkSession)
    words = tokens(sql) if words is None else words
    blocks = _scope_rows(words).checkpoint()  # a row or two a statement
    # all tables below are dealt out by file alike, so their joins need no further shuffle
    held = dealt(_sources(words, blocks))
    by_scope = held.withColumnRenamed("scope", "above")
    seen = matched(dealt(_mentions(words)), dealt(_reaches(blocks)), ["file_name", "s"])
    place = F.col("pos").alias("owner_at")

    last = F.lower(F.substring_index("name", ".", -1))
    called = by_scope.select("file_name", "above", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("alias"), last)))).alias("key"), F.lower("alias").alias("as"), "name", "kind", place)
    by_name = matched(seen.filter("key IS NOT NULL"), called, ["file_name", "above", "key"], "left")
    # the nearest scope; in it an alias goes before the name of a table that has another alias
    nearest = W.partitionBy("file_name", "pos").orderBy(F.col("owner_at").isNull(), "steps", F.coalesce(F.col("as") != F.col("key"), F.lit(True)), "owner_at")
    by_name = by_name.withColumn("n", F.row_number().over(nearest)).filter("n = 1").withColumn("sources", F.when(F.col("owner_at").isNotNull(), F.array("owner_at")).otherwise(F.array().cast("array<int>")))

    all_of = by_scope.groupBy("file_name", "above").agg(F.array_sort(F.collect_list(place)).alias("sources"), F.first("name").alias("name"), F.first("kind").alias("kind"))
    plain = matched(seen.filter("key IS NULL"), all_of, ["file_name", "above"], "left")
    nearest = W.partitionBy("file_name", "pos").orderBy(F.col("sources").isNull(), "steps")
    plain = plain.withColumn("n", F.row_number().over(nearest)).filter("n = 1").withColumn("sources", F.coalesce("sources", F.array().cast("array<int>")))

    one = F.size("sources") == 1
    status = F.when(one, "owned").when(F.size("sources") > 1, "ambiguous").otherwise("unknown")
    told = lambda rows: rows.select("file_name", F.col("s").alias("scope"), "qualifier", "column", F.when(one, F.col("name")).alias("owner"), F.when(one, F.col("kind")).alias("owner_kind"), status.alias("status"), F.col("sources").alias("candidates"), "pos")
    return held, told(by_name).unionByName(told(plain))


#: Columns of tokens that facts are read off.
_OF_FACTS = "token word before1 before2 before3 after1 after2 block first pos end line start level next_end pair statement until case_depth spaced read".split()


def kept_tokens(sql: DataFrame) -> DataFrame:
    """``tokens`` cut once and settled, with the columns that facts are read off, for readers of several kinds of facts."""
    return settled(tokens(sql).select("file_name", *_OF_FACTS), "script-tokens")


def summary(sql: DataFrame) -> DataFrame:
    """Numbers of facts per file, and whether they need a review: facts are missing for words that stand in it, or it has no tables.

    The scripts are cut into tokens once; all kinds of facts read what they need of them.
    """
    kinds = {"variables": variables, "set_statements": set_statements, "tables": tables, "unique_tables": unique_tables, "joins": joins, "cases": cases, "business_rules": business_rules, "where_conditions": where_conditions, "group_by": group_by, "column_references": column_references}
    words = kept_tokens(sql)
    counts = [extract(sql, words=words).groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for kind, extract in kinds.items()]
    wide = reduce(DataFrame.unionByName, counts).groupBy("file_name").pivot("kind", list(kinds)).agg(F.sum("n"))
    raw = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    expected = sql.select("file_name", raw(r"(?i)\bJOIN\b").alias("raw_joins"), raw(r"(?i)\bCASE\b").alias("raw_cases"), raw(r"(?i)\bDECLARE\s+@").alias("raw_variables"))
    full = matched(expected, wide, "file_name", "left").fillna(0, list(kinds))
    review = (F.col("raw_joins") != F.col("joins")) | (F.col("raw_cases") != F.col("cases")) | (F.col("raw_variables") != F.col("variables")) | (F.col("tables") == 0)
    return full.withColumn("status", F.when(review, "REVIEW").otherwise("PASS"))

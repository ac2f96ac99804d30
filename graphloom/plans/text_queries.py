"""Queries on files, names, lines, questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vocabulary as V
from graphloom.operators import windows
from graphloom.plans.tables import SOURCE_FILES_SQL, source_files, table


def _windows_sql(size: int, overlap: int) -> str:
    return rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, lines, len(lines) AS n, unnest(range(0, len(lines), {size - overlap})) AS a FROM l),
w AS (SELECT doc_id, CAST(a // {size - overlap} AS INTEGER) AS chunk_index, CAST(a + 1 AS INTEGER) AS line_start, CAST(least(a + {size}, n) AS INTEGER) AS line_end,
  regexp_replace(array_to_string(list_slice(lines, a + 1, a + {size}), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM s WHERE a = 0 OR a + {overlap} < n)
SELECT * FROM w WHERE text <> ''"""


def sliding_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows.line_windows(table(spark, d, "documents"), "doc_id", "text")


def sliding_window_small(spark: SparkSession, d: str) -> DataFrame:
    return windows.line_windows(table(spark, d, "documents"), "doc_id", "text", size=5, overlap=2)


def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files with their type, lines and bytes; of files with one name the first stays."""
    files = source_files(spark, d).filter(T.suffix_of(F.col("file_name")).isin(*V.EXTENSIONS))
    kind = T.source_type(F.col("file_name"))
    rows = files.select("file_name", kind.alias("source_type"), F.size(F.split("text", "\n", -1)).alias("total_lines"), F.octet_length("text").alias("size_bytes"), "doc_id")
    return windows.first_of_each(rows, ["file_name"], "doc_id").drop("doc_id")


SOURCE_INVENTORY = f"""
SELECT file_name, CASE lower(regexp_extract(file_name, '\\.[a-zA-Z]+$')) WHEN '.sql' THEN 'sql' WHEN '.cbl' THEN 'cobol' WHEN '.dtsx' THEN 'ssis' END AS source_type,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS total_lines, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes
FROM {SOURCE_FILES_SQL} WHERE NOT file_name LIKE '%.txt' QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY doc_id) = 1"""


def technology_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = source_inventory(spark, d)
    return rows.groupBy("source_type").agg(F.count(F.lit(1)).alias("files"), F.sum("total_lines").alias("lines"), F.max("size_bytes").alias("largest"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"))


def dedupe_by_hash(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"))
    return keyed.groupBy("content_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.concat(F.lit("PC_"), "c_name", F.lit(" ")).alias("name")).unionByName(table(spark, d, "part").select(F.concat(F.lit("ccx_"), "p_brand", F.lit("."), "p_name").alias("name")))
    return names.select("name", T.normalised_name(F.col("name")).alias("norm")).distinct()


NORMALISED_NAMES = r"""
WITH n AS (SELECT 'PC_' || c_name || ' ' AS name FROM customer UNION SELECT 'ccx_' || p_brand || '.' || p_name FROM part)
SELECT name, regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '^(pcx_|pc_|ccx_|cc_|bc_|ab_)', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS norm FROM n"""


def clean_identifier(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" [db] . ["), "p_brand", F.lit("] .`"), "p_name", F.lit("` "))
    return table(spark, d, "part").select(raw.alias("raw")).distinct().select("raw", T.sql_identifier(F.col("raw")).alias("sql_name"), T.plain_identifier(F.col("raw")).alias("plain_name"))


CLEAN_IDENTIFIER = r"""
WITH r AS (SELECT DISTINCT ' [db] . [' || p_brand || '] .`' || p_name || '` ' AS raw FROM part)
SELECT raw, trim(regexp_replace(regexp_replace(raw, '\s*\.\s*', '.', 'g'), '[\[\]]', '', 'g')) AS sql_name,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '[\[\]`"'']', '', 'g'), '\s*\.\s*', '.', 'g'), '\s+', ' ', 'g')) AS plain_name FROM r"""


def token_filter(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.array_join(T.terms(F.concat_ws(" ", F.lit("Which tables feed"), "text")), " ").alias("terms"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
TOKEN_FILTER = f"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(concat_ws(' ', 'Which tables feed', text)), '[A-Za-z0-9_\\-]+'), lambda x: length(x) >= 3) AS w FROM conversations WHERE role = 'user'),
s AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_LIST(V.STOP_TERMS)}, x)) AS s FROM w)
SELECT conv_id, turn, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE list_filter(w, lambda x: NOT list_contains({_LIST(V.BASIC_STOP_TERMS)}, x)) END, ' ') AS terms FROM s"""


def file_refs(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("see "), "file_name", F.lit(", also Load_"), "source", F.lit(".SQL and x.exe"))
    return source_files(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(T.file_names(said))), ",").alias("files"))


FILE_REFS = rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all('see ' || file_name || ', also Load_' || source || '.SQL and x.exe', '(?i)[A-Za-z0-9_\-]+\.(?:cbl|cob|cpy|dtsx|sql|xml|py)'))), ',') AS files FROM {SOURCE_FILES_SQL}"""


def type_normalisation(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events").select("event_type").distinct()
    words = kinds.select(F.explode(F.array(F.lit("Reads"), F.lit("group by"), F.lit("data-flow"), F.lit("Data Flow"), F.lit("field"), F.lit(""), F.col("event_type"))).alias("word")).distinct()
    return words.select("word", T.relationship_type(F.col("word")).alias("relationship_type"), T.entity_type(F.col("word")).alias("entity_type"), T.node_label(F.col("word")).alias("label"))


def _case(types: dict, key: str, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {key} IN ({", ".join(repr(n) for n in names)}) THEN {kind!r}' for kind, names in types.items())} ELSE '{default}' END"


TYPE_NORMALISATION = f"""
WITH w AS (SELECT event_type AS word FROM events UNION SELECT unnest(['Reads', 'group by', 'data-flow', 'Data Flow', 'field', '']))
SELECT word, {_case(V.RELATIONSHIP_TYPES, "replace(replace(lower(trim(word)), ' ', '_'), '-', '_')", "USES")} AS relationship_type,
  {_case(V.ENTITY_TYPES, "replace(lower(trim(word)), ' ', '_')", "TABLE")} AS entity_type,
  CASE WHEN lower(word) IN ({", ".join(repr(x) for x in V.NODE_LABELS)}) THEN upper(word[1]) || lower(word[2:]) ELSE 'Entity' END AS label FROM w"""


def intent_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


INTENT_LADDER = f"""
SELECT conv_id, turn, CASE {" ".join(f"WHEN {' OR '.join(f'contains(q, {w!r})' for w in words)} THEN {kind!r}" for kind, words in V.INTENTS.items())} ELSE 'semantic' END AS intent
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations WHERE role = 'user')"""


def answer_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of answers put together from the turns of a conversation."""
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    line = F.substring_index(F.col("text"), "\n", 1)
    answer = F.concat(F.lit("ANSWER:\n"), line, F.lit("\n### KEY POINTS\n- "), line, F.lit("\n**SOURCES**\na.sql, b.cbl\nGAPS: none"))
    made = turns.select("conv_id", "turn", answer.alias("answer"))
    return made.select("conv_id", "turn", *[T.answer_section(F.col("answer"), n).alias(n) for n in ("answer", "key_points", "sources", "gaps")])


ANSWER_SECTIONS = r"""
SELECT conv_id, turn, trim(l, chr(32) || chr(9) || chr(10) || chr(13)) AS answer, trim('- ' || l, chr(32) || chr(9) || chr(10) || chr(13)) AS key_points, 'a.sql, b.cbl' AS sources, 'none' AS gaps
FROM (SELECT conv_id, turn, string_split(text, chr(10))[1] AS l FROM conversations WHERE role = 'assistant')"""


def section_extents(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end a sentence as headers: each reaches to the line before the next."""
    lines = windows.lines_of(table(spark, d, "documents"), "doc_id", "text")
    n = F.max("line_number").over(W.partitionBy("doc_id"))
    headers = lines.withColumn("last", n).filter("length(line) < 40 AND line LIKE '%.'").select("doc_id", F.col("line_number").alias("start"), "last")
    return windows.extents(headers, "doc_id", "start", F.col("last")).drop("last")


_LINES = "(SELECT doc_id, generate_subscripts(l, 1) AS line_number, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
SECTION_EXTENTS = f"""
SELECT doc_id, CAST(line_number AS INTEGER) AS start, CAST(coalesce(lead(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) - 1, n) AS INTEGER) AS "end"
FROM {_LINES} WHERE length(line) < 40 AND line LIKE '%.'"""


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last user turn that each turn of a conversation follows."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.carried_forward(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at")


CARRY_FORWARD = "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations"


def nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of list and section tags in pages."""
    tags = F.regexp_extract_all("html", F.lit("</?(?:ul|nav|div|article|html|body)[ >]"), F.lit(0))
    tokens = table(spark, d, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return windows.nesting(tokens, "page_id", "pos", ~F.col("tag").startswith("</"))


NESTING_DEPTH = """
WITH t AS (SELECT page_id, regexp_extract_all(html, '</?(?:ul|nav|div|article|html|body)[ >]') AS l FROM pages),
e AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS tag FROM t),
r AS (SELECT *, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT page_id, pos, tag, CAST(CASE WHEN tag LIKE '</%' THEN run ELSE run - 1 END AS INTEGER) AS depth FROM r"""


def markup_extract(spark: SparkSession, d: str) -> DataFrame:
    """Title, language and first heading of pages."""
    first = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, d, "pages").select("page_id", first("<title>([^<]*)</title>").alias("title"), first('<html lang="([a-z]+)"').alias("lang"), first("<h1>([^<]*)</h1>").alias("heading"))


MARKUP_EXTRACT = """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages"""


def markup_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


MARKUP_LINKS = """WITH t AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS href FROM t"""


def evidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a source: 0 without rows, 0.88 if any is doubtful, else 1; with the sorted list of its languages."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    doubtful = F.max(F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.when(doubtful, 0.88).otherwise(1.0).alias("confidence"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("languages"))


EVIDENCE_ROLLUP = "SELECT source, count(*) AS records, CASE WHEN max(CASE WHEN coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) = 1 THEN 0.88 ELSE 1.0 END::DOUBLE AS confidence, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def reconcile_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels by what confirms what."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    both = docs.join(labels, "doc_id", "left_semi").withColumn("bucket", F.lit("confirmed"))
    only = docs.join(labels, "doc_id", "left_anti").withColumn("bucket", F.lit("parser_only"))
    inferred = labels.join(docs, "doc_id", "left_anti").withColumn("bucket", F.lit("inferred"))
    return both.unionByName(only).unionByName(inferred).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


RECONCILE_SETS = """
WITH b AS (SELECT doc_id, 'confirmed' AS bucket FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'parser_only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'inferred' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))
SELECT bucket, count(*) AS n, min(doc_id) AS first_id FROM b GROUP BY bucket"""


def first_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Fall-back evidence: the first five documents that hold a term, 1,500 characters of each."""
    hit = F.lower("text").contains("theation") | F.lower("text").contains("thing")
    return table(spark, d, "documents").filter(hit).orderBy("doc_id").limit(5).select("doc_id", F.substring("text", 1, 1500).alias("excerpt"))


FIRST_SUMMARIES = "SELECT doc_id, substr(text, 1, 1500) AS excerpt FROM documents WHERE contains(lower(text), 'theation') OR contains(lower(text), 'thing') ORDER BY doc_id LIMIT 5"


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of chunks for an idempotent upsert."""
    return source_files(spark, d).select("file_name", T.point_id(F.col("file_name")).alias("point_id"))


POINT_IDS = f"""SELECT file_name, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id
FROM (SELECT file_name, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(file_name)) AS h FROM {SOURCE_FILES_SQL} f)"""


def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows any column of which holds a text, taken literally."""
    rows = table(spark, d, "part")
    hit = None
    for c in rows.columns:
        one = F.coalesce(F.lower(F.col(c).cast("string")).contains("red"), F.lit(False))
        hit = one if hit is None else hit | one
    return rows.filter(hit).select("p_partkey", "p_name", "p_brand", "p_type")


KEYWORD_FILTER = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')"

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (sliding_window_chunks, _windows_sql(50, 10)), (sliding_window_small, _windows_sql(5, 2)), (source_inventory, SOURCE_INVENTORY),
        (technology_statistics, f"SELECT source_type, count(*) AS files, CAST(sum(total_lines) AS BIGINT) AS lines, max(size_bytes) AS largest FROM ({SOURCE_INVENTORY}) GROUP BY source_type"),
        (content_hash, r"SELECT doc_id, substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 12) AS content_key FROM documents"),
        (dedupe_by_hash, r"SELECT substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 12) AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
        (normalised_names, NORMALISED_NAMES), (clean_identifier, CLEAN_IDENTIFIER), (token_filter, TOKEN_FILTER), (file_refs, FILE_REFS), (type_normalisation, TYPE_NORMALISATION),
        (intent_ladder, INTENT_LADDER), (answer_sections, ANSWER_SECTIONS), (section_extents, SECTION_EXTENTS), (carry_forward, CARRY_FORWARD), (nesting_depth, NESTING_DEPTH),
        (markup_extract, MARKUP_EXTRACT), (markup_links, MARKUP_LINKS), (evidence_rollup, EVIDENCE_ROLLUP), (reconcile_sets, RECONCILE_SETS), (first_summaries, FIRST_SUMMARIES),
        (point_ids, POINT_IDS), (keyword_filter, KEYWORD_FILTER),
    )
}

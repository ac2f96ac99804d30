"""Links of programs of six shapes, a shape by part; the SQL twins state what each shape holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import cobol
from graphloom.operators import package
from graphloom.plans import artifacts as A
from graphloom.plans.tables import table
from graphloom.session import shared_folder
from graphloom.sources.graph_store import GraphStore

_HEAD = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PG%1$d.
       ENVIRONMENT DIVISION.
       FILE-CONTROL.
           SELECT OUT-FILE ASSIGN TO "O%2$d".
           SELECT IN-FILE ASSIGN TO IN%2$d.
       DATA DIVISION.
       FILE SECTION.
       FD  OUT-FILE.
       01  OUT-REC-%1$d.
           05  A PIC X.
       01  ALT-REC.
           05  B PIC X.
       FD  IN-FILE.
       01  IN-REC PIC X(80).
       WORKING-STORAGE SECTION.
       01  WS-REC.
           05  C PIC X.
       PROCEDURE DIVISION.
       MAIN-P.
"""
#: Programs, %1$d a key and %2$d a number; statements of one line, of several, and several in a line.
SHAPES = tuple(
    _HEAD + body
    for body in (
        "           WRITE OUT-REC-%1$d.\n           WRITE ALT-REC\n               FROM WS-REC.\n           STOP RUN.\n",
        "           IF C = 1 PERFORM 0200-A THRU 0200-EXIT.\n           WRITE WS-REC.\n       0200-A.\n           READ IN-FILE AT END MOVE 1 TO C.\n       0200-B.\n           EXIT.\n       0200-EXIT.\n           EXIT.\n       0300-END.\n           GOBACK.\n",
        "           CALL 'SUB%2$d' USING A B.\n           CALL WS-PGM\n               USING C.\n           IF A = B CALL \"LAST%1$d\" END-IF.\n",
        "      *    WRITE ALT-REC.\n           PERFORM UNTIL C = 9 READ IN-FILE AT END PERFORM P-END END-READ END-PERFORM.\n           REWRITE IN-REC.\n       P-END.\n           PERFORM 3 TIMES ADD 1 TO C END-PERFORM.\n",
        "           IF A = 1 MOVE 1 TO C ELSE PERFORM P-B UNTIL C = 1 END-IF\n           GO TO P-C.\n       P-B.\n           GO P-C.\n       P-C.\n           PERFORM P-B THROUGH P-UNKNOWN.\n",
        "           DISPLAY \"PERFORM NOTHING\" 'CALL IT'.\n           WRITE OUT-FILE.\n           MOVE 1.5 TO C. WRITE IN-REC. READ OUT-FILE.\n",
    )
)


def programs(spark: SparkSession, d: str) -> DataFrame:
    """A program a part, of the shape that its key names."""
    texts = F.array(*[F.format_string(s, F.col("p_partkey"), F.col("p_size")) for s in SHAPES])
    return table(spark, d, "part").select(F.concat(F.lit("PGM"), "p_partkey", F.lit(".CBL")).alias("file_name"), F.get(texts, (F.col("p_partkey") % len(SHAPES)).cast("int")).alias("text"))


def cobol_links(spark: SparkSession, d: str) -> DataFrame:
    return cobol.links(cobol.program_lines(programs(spark, d)))


def cobol_file_records(spark: SparkSession, d: str) -> DataFrame:
    return cobol.file_records(cobol.program_lines(programs(spark, d)))


def cobol_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements by paragraph and kind, counted."""
    return cobol.statements(cobol.program_lines(programs(spark, d))).groupBy("file_name", "paragraph", "op").agg(F.count(F.lit(1)).alias("n"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Programs and packages as files of their source types."""
    return programs(spark, d).withColumn("source_type", F.lit("cobol")).unionByName(A.packages(spark, d).withColumn("source_type", F.lit("ssis")))


def artifact_nodes(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return package.graph_elements(files, *package.facts_of(files))[0].distinct()


def artifact_edges(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return package.graph_elements(files, *package.facts_of(files))[1].distinct()


def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """Packages of programs and of data-flow packages, merged into a graph store in two batches, one of them handed over twice."""
    packed = package.stored_packages(_files(spark, d))
    store = GraphStore(spark, shared_folder(spark, "graph-store"), buckets=8)
    for batch, kind in enumerate(("cobol", "ssis", "ssis")):
        store.merge(packed.filter(F.col("source_type") == kind), min(batch, 1))
    return store.table("edges").groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.max("source_file").alias("last_file"))


_LINKS = (
    ["s.file_name, 'WRITES', 'OUT-FILE'", "'OUT-FILE', 'WRITES_RECORD', 'OUT-REC-' || k", "'OUT-FILE', 'WRITES_RECORD', 'ALT-REC'"],
    ["'MAIN-P', 'PERFORMS', '0200-A'", "'MAIN-P', 'PERFORMS', '0200-B'", "'MAIN-P', 'PERFORMS', '0200-EXIT'", "s.file_name, 'WRITES', 'WS-REC'", "s.file_name, 'READS', 'IN-FILE'"],
    ["s.file_name, 'CALLS', 'SUB' || n", "s.file_name, 'CALLS', 'WS-PGM'", "s.file_name, 'CALLS', 'LAST' || k"],
    ["s.file_name, 'READS', 'IN-FILE'", "'MAIN-P', 'PERFORMS', 'P-END'", "s.file_name, 'WRITES', 'IN-FILE'", "'IN-FILE', 'WRITES_RECORD', 'IN-REC'"],
    ["'MAIN-P', 'PERFORMS', 'P-B'", "'MAIN-P', 'GOES_TO', 'P-C'", "'P-B', 'GOES_TO', 'P-C'", "'P-C', 'PERFORMS', 'P-B'", "'P-C', 'PERFORMS', 'P-UNKNOWN'"],
    ["s.file_name, 'WRITES', 'OUT-FILE'", "'OUT-FILE', 'WRITES_RECORD', 'OUT-FILE'", "s.file_name, 'WRITES', 'IN-FILE'", "'IN-FILE', 'WRITES_RECORD', 'IN-REC'", "s.file_name, 'READS', 'OUT-FILE'"],
)
_STATEMENTS = (
    ["'MAIN-P', 'write', 2::BIGINT", "'MAIN-P', 'stop', 1"],
    ["'MAIN-P', 'if', 1::BIGINT", "'MAIN-P', 'perform', 1", "'MAIN-P', 'write', 1", "'0200-A', 'read', 1", "'0200-A', 'move', 1", "'0200-B', 'exit', 1", "'0200-EXIT', 'exit', 1", "'0300-END', 'goback', 1"],
    ["'MAIN-P', 'call', 3::BIGINT", "'MAIN-P', 'if', 1"],
    ["'MAIN-P', 'perform', 2::BIGINT", "'MAIN-P', 'read', 1", "'MAIN-P', 'rewrite', 1", "'P-END', 'perform', 1", "'P-END', 'add', 1"],
    ["'MAIN-P', 'if', 1::BIGINT", "'MAIN-P', 'move', 1", "'MAIN-P', 'else', 1", "'MAIN-P', 'perform', 1", "'MAIN-P', 'go', 1", "'P-B', 'go', 1", "'P-C', 'perform', 1"],
    ["'MAIN-P', 'display', 1::BIGINT", "'MAIN-P', 'write', 2", "'MAIN-P', 'move', 1", "'MAIN-P', 'read', 1"],
)


def _by_shape(columns: str, rows: tuple[list[str], ...]) -> str:
    return " UNION ALL ".join(A.stated(f"(SELECT * FROM {A.PROGRAMS} WHERE k % {len(SHAPES)} = {i})", columns, *r) for i, r in enumerate(rows))


_PARAGRAPHS = (["MAIN-P"], ["MAIN-P", "0200-A", "0200-B", "0200-EXIT", "0300-END"], ["MAIN-P"], ["MAIN-P", "P-END"], ["MAIN-P", "P-B", "P-C"], ["MAIN-P"])
_ENTITIES = ("'FILE', 'OUT-FILE'", "'FILE', 'IN-FILE'", "'RECORD', 'OUT-REC-' || k", "'RECORD', 'ALT-REC'", "'RECORD', 'WS-REC'", "'VARIABLE', 'A'", "'VARIABLE', 'B'", "'VARIABLE', 'C'", "'VARIABLE', 'IN-REC'")
_PARTS = ("'DATABASE', 'DW'", "'TASK', 'T0'", "'TASK', 'T1'", "'COMPONENT', 'SRC'", "'COMPONENT', 'DST'")
_HELD = f"({_by_shape('kind name', tuple([*_ENTITIES, *[f"'PROCEDURE', '{p}'" for p in ps]] for ps in _PARAGRAPHS))} UNION ALL {A.stated(A.PACKAGES, 'kind name', *_PARTS)})"
_ALL_FILES = f"(SELECT file_name FROM {A.PROGRAMS} p UNION ALL SELECT file_name FROM {A.PACKAGES} q)"
_SQL_STEPS = f"(SELECT file_name, 'TRANSFORMATION:' || file_name || ':' || r AS id, r FROM {A.PACKAGES} q, (VALUES ('SQL-1'), ('SQL-2')) v(r))"
ARTIFACT_NODES = f"""SELECT file_name, 'ARTIFACT:' || file_name AS id, 'Artifact' AS label, file_name AS name FROM {_ALL_FILES} f UNION ALL
SELECT file_name, kind || ':' || name, upper(kind[1]) || lower(kind[2:]), name FROM {_HELD} h UNION ALL SELECT file_name, id, 'Transformation', r FROM {_SQL_STEPS} t"""
_KINDS = {"READS": ("PROGRAM", "FILE"), "WRITES": ("PROGRAM", "FILE"), "WRITES_RECORD": ("FILE", "RECORD"), "CALLS": ("PROGRAM", "PROGRAM"), "PERFORMS": ("PROCEDURE", "PROCEDURE"), "GOES_TO": ("PROCEDURE", "PROCEDURE")}
_CASE = lambda i: "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _KINDS.items()) + " END"
_FLOWS = ("'COMPONENT:SRC', 'FEEDS_INTO', 'COMPONENT:DST'", "'TASK:T0', 'PRECEDES', 'TASK:T1'", "'TASK:T1', 'PRECEDES', 'TASK:T2'", "'TASK:L' || k, 'PRECEDES', 'TASK:L' || k")
ARTIFACT_EDGES = f"""SELECT DISTINCT file_name, 'ARTIFACT:' || file_name AS src, 'CONTAINS' AS type, kind || ':' || name AS dst FROM {_HELD} h UNION ALL
SELECT file_name, CASE WHEN source = file_name THEN 'ARTIFACT' ELSE {_CASE(0)} END || ':' || source, type, {_CASE(1)} || ':' || target FROM ({_by_shape("source type target", _LINKS)}) l UNION ALL
{A.stated(A.PACKAGES, "src type dst", *_FLOWS)}"""
_STORED = f"(SELECT * FROM ({ARTIFACT_EDGES}) e UNION ALL SELECT file_name, 'ARTIFACT:' || file_name, 'HAS_TRANSFORMATION', 'TRANSFORM:' || file_name || ':' || r FROM {_SQL_STEPS} t)"
STORED_GRAPH = f"SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, max(last) AS last_file FROM (SELECT src, type, dst, coalesce(max(file_name) FILTER (WHERE file_name LIKE '%.dtsx'), max(file_name)) AS last FROM {_STORED} s GROUP BY src, type, dst) GROUP BY type"


QUERIES = {
    "artifact_nodes": (artifact_nodes, ARTIFACT_NODES),
    "artifact_edges": (artifact_edges, ARTIFACT_EDGES),
    "stored_graph": (stored_graph, STORED_GRAPH),
    "cobol_links": (cobol_links, _by_shape("source type target", _LINKS)),
    "cobol_file_records": (cobol_file_records, A.stated(A.PROGRAMS, "file record line", "'OUT-FILE', 'OUT-REC-' || k, 10", "'OUT-FILE', 'ALT-REC', 12", "'IN-FILE', 'IN-REC', 15")),
    "cobol_statements": (cobol_statements, _by_shape("paragraph op n", _STATEMENTS)),
}

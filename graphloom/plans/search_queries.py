"""Queries of the posting index, of containment joins and of searches along edges, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, joins
from graphloom.operators.postings import TextIndex, capped, per_source
from graphloom.plans.graph_queries import _LINEAGE, _STARTS_SQL, _starts
from graphloom.plans.tables import EDGES_SQL, NODES_SQL, SOURCE_FILES_SQL, edges, nodes, source_files, table
from graphloom.session import shared_folder
from graphloom.sources.vector_store import VectorStore

#: What is searched for: the first eight terms of a question. One holds no fact, one is shorter than a trigram.
TERMS = ("widget", "brand#1", "customer#00000001", "nation:1", "ECO", "machin", "no such name", "r#")
SOURCES = ["rule", "transformation", "entity", "edge"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Rules, transformations, entities and edges (source, id, file, texts): parts, customers, and the graph of the tables."""
    rules = table(spark, d, "part").select(F.lit("rule").alias("source"), F.concat(F.lit("RULE:"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.array(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("texts"))
    steps = table(spark, d, "customer").select(F.lit("transformation").alias("source"), F.concat(F.lit("T:"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("file"), F.array("c_name", "c_mktsegment").alias("texts"))
    entities = nodes(spark, d).select(F.lit("entity").alias("source"), "id", F.col("source_file").alias("file"), F.array("name").alias("texts"))
    lines = edges(spark, d).select(F.lit("edge").alias("source"), F.concat_ws(">", "src", "type", "dst").alias("id"), F.col("type").alias("file"), F.array("src", "dst").alias("texts"))
    return rules.unionByName(steps).unionByName(entities).unionByName(lines)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    found = facts(spark, d)
    index = TextIndex(spark, shared_folder(spark, "postings")).build(found)
    return per_source(index.search(found, list(TERMS)), "id")


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """At most ten facts of each term and source, looked up in a posting index of rules, transformations, entities and edges."""
    return _hits(spark, d).select("term_no", "term", "source", "id", "rank")


def indexed_search_capped(spark: SparkSession, d: str) -> DataFrame:
    """Twenty records in all, term by term and source by source, each text of a file once."""
    hits = _hits(spark, d).withColumn("shown", F.array_join("texts", "|"))
    return capped(hits, SOURCES, ["file", "shown"]).select("term_no", "source", "id", "file", "shown")


_FACTS_SQL = f"""(SELECT 'rule' AS source, 'RULE:' || p_partkey AS id, p_brand AS file, [concat_ws(' ', p_type, p_name, p_brand)] AS texts FROM part
UNION ALL SELECT 'transformation', 'T:' || c_custkey, c_mktsegment, [c_name, c_mktsegment] FROM customer
UNION ALL SELECT 'entity', id, source_file, [name] FROM {NODES_SQL} n
UNION ALL SELECT 'edge', src || '>' || type || '>' || dst, type, [src, dst] FROM {EDGES_SQL} e)"""
_TERMS_SQL = "(VALUES " + ", ".join(f"({i}, '{t.lower()}')" for i, t in enumerate(TERMS)) + ") AS t(term_no, term)"
_HITS_SQL = f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY term_no, source ORDER BY id) AS INTEGER) AS rank FROM {_FACTS_SQL} f JOIN {_TERMS_SQL} ON len(list_filter(texts, lambda x: contains(lower(x), term))) > 0) WHERE rank <= 10)"
INDEXED_SEARCH = f"SELECT term_no, term, source, id, rank FROM {_HITS_SQL} h"
INDEXED_CAPPED = f"""SELECT term_no, source, id, file, shown FROM (SELECT *, row_number() OVER (PARTITION BY source, file, shown ORDER BY term_no, rank) AS again FROM (SELECT *, array_to_string(texts, '|') AS shown FROM {_HITS_SQL} h))
WHERE again = 1 ORDER BY term_no, list_position(['rule', 'transformation', 'entity', 'edge'], source), rank LIMIT 20"""


def package_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Files with the package of their name, or else the first whose stem they contain."""
    named = F.concat(F.lit("DOC_"), "p_size", F.when(F.col("p_size") % 3 == 0, ".sql").otherwise(".json"))
    packages = table(spark, d, "part").select(named.alias("file_name")).distinct()
    return joins.with_package(source_files(spark, d).select("file_name"), packages)


PACKAGE_BY_NAME = f"""WITH p AS (SELECT DISTINCT 'DOC_' || p_size || CASE WHEN p_size % 3 = 0 THEN '.sql' ELSE '.json' END AS package FROM part),
x AS (SELECT f.file_name, min(package) FILTER (WHERE lower(package) = lower(f.file_name)) AS exact, min(package) FILTER (WHERE contains(lower(f.file_name), lower(regexp_replace(package, '\\.[^.]*$', '')))) AS inside FROM {SOURCE_FILES_SQL} f LEFT JOIN p ON true GROUP BY f.file_name)
SELECT f.file_name, coalesce(exact, inside) AS package, CASE WHEN exact IS NOT NULL THEN 'name' WHEN inside IS NOT NULL THEN 'contains' END AS matched FROM {SOURCE_FILES_SQL} f JOIN x USING (file_name)"""


def catalogued_sources(spark: SparkSession, d: str) -> DataFrame:
    """Cited sources that end with a name of the catalogue; of answers without such, all but dummies."""
    cited = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer"), F.explode(F.array(F.concat(F.lit("src/DOC_"), F.col("o_custkey"), F.lit(".SQL")), F.concat(F.when(F.col("o_orderstatus") == "F", "dummy_").otherwise("x_"), F.col("o_custkey")))).alias("source"))
    return joins.in_catalogue(cited, source_files(spark, d).select("file_name"))


CATALOGUED = f"""WITH c AS (SELECT o_orderkey AS answer, unnest(['src/DOC_' || o_custkey || '.SQL', CASE WHEN o_orderstatus = 'F' THEN 'dummy_' ELSE 'x_' END || o_custkey]) AS source FROM orders),
k AS (SELECT DISTINCT s.source FROM (SELECT DISTINCT source FROM c) s JOIN {SOURCE_FILES_SQL} f ON ends_with(lower(s.source), lower(f.file_name))),
t AS (SELECT c.*, k.source IS NOT NULL AS known, bool_or(k.source IS NOT NULL) OVER (PARTITION BY answer) AS got FROM c LEFT JOIN k ON k.source = c.source)
SELECT answer, source FROM t WHERE CASE WHEN got THEN known ELSE NOT contains(lower(source), 'dummy') END"""


def lineage_reach(spark: SparkSession, d: str) -> DataFrame:
    """All that the starts reach by edges of lineage within three hops, with the fewest."""
    return graph.reached(edges(spark, d, once=False), _starts(spark), 3, _LINEAGE)


def search_then_expand(spark: SparkSession, d: str) -> DataFrame:
    """The first node by name that holds a term, and what lies within two edges of it."""
    found = nodes(spark, d)
    hits = found.filter(graph.holds([F.col("name")], "supplier#00000000")).select("id", F.col("name").alias("at"))
    return graph.searched_then_reached(found, edges(spark, d, once=False), hits, 2)


def _reach_sql(starts: str, hops: int, types: str = "true") -> str:
    links = f'l AS (SELECT DISTINCT src AS "at", dst AS "to" FROM {EDGES_SQL} e WHERE {types} UNION SELECT DISTINCT dst, src FROM {EDGES_SQL} e WHERE {types})'
    steps = [f'h{k} AS (SELECT DISTINCT start, l."to" AS id FROM h{k - 1} JOIN l ON h{k - 1}.id = l."at")' for k in range(1, hops + 1)]
    found = " UNION ALL ".join(f"SELECT start, id, {k} AS hops FROM h{k}" for k in range(1, hops + 1))
    return f"WITH s AS {starts}, {links}, h0 AS (SELECT id AS start, id FROM s), {', '.join(steps)} SELECT start, id, min(hops) AS hops FROM ({found}) WHERE start <> id GROUP BY start, id"


LINEAGE_REACH = _reach_sql(f"(SELECT id FROM {_STARTS_SQL} s0)", 3, f"type IN ({', '.join(repr(t) for t in _LINEAGE)})")
_FIRST = f"(SELECT id FROM {NODES_SQL} n WHERE contains(lower(name), 'supplier#00000000') ORDER BY name, id LIMIT 1)"
SEARCH_THEN_EXPAND = f"SELECT r.id, n.label, n.name, r.hops FROM ({_reach_sql(_FIRST, 2)}) r LEFT JOIN {NODES_SQL} n ON n.id = r.id"

def stored_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest points by cosine of every fiftieth one, out of a store into which a second batch has put some turned round."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    store = VectorStore(spark, shared_folder(spark, "vectors"))
    store.upsert(points, 0)
    store.upsert(points.filter("id % 10 = 3").withColumn("vector", F.transform("vector", lambda x: -x)), 1)
    return store.search(points.filter("id % 50 = 0").withColumnRenamed("id", "query_id")).withColumn("score", F.round("score", 6))


STORED_NEAREST = """WITH p AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 10 = 3 THEN -x ELSE x END) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, id, list_cosine_similarity(v, w) AS c FROM p, q)
SELECT query_id, id, round(c, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS r FROM s) WHERE r <= 5"""

QUERIES = {f.__name__: (f, text) for f, text in ((indexed_search, INDEXED_SEARCH), (indexed_search_capped, INDEXED_CAPPED), (package_by_name, PACKAGE_BY_NAME), (catalogued_sources, CATALOGUED), (lineage_reach, LINEAGE_REACH), (search_then_expand, SEARCH_THEN_EXPAND), (stored_nearest, STORED_NEAREST))}

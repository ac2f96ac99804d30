"""Queries on the graph of the order tables, on entities across files and on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import discovery, graph, joins, vectors, windows
from graphloom.plans.tables import EDGES_SQL, NODES_SQL, PART_ENTITIES_SQL, SYMMETRIC_SQL, edges, nodes, part_entities, table

_STARTS = ("SUPPLIER:1", "PART:3", "ORDER:7")
_STARTS_SQL = f"(SELECT unnest([{', '.join(repr(s) for s in _STARTS)}]) AS id)"
_LINEAGE = ("READS_FROM", "WRITES_TO", "TRANSFORMS", "USES", "FEEDS_INTO")


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _STARTS], "id string")


def shared_entities(spark: SparkSession, d: str) -> DataFrame:
    """Which entities are shared across files, and how are they related."""
    related = discovery.classified(discovery.candidate_pairs(part_entities(spark, d)))
    counts = related.groupBy("norm", "relationship_type").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("source_file").alias("source_files"))
    return counts.orderBy(F.desc("pairs"), "norm", "relationship_type").limit(10)


_PAIRS = rf"""(WITH e AS (SELECT DISTINCT id, source_file, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS norm FROM {PART_ENTITIES_SQL} p)
SELECT a.norm, a.id AS source_entity_id, a.source_file, b.id AS target_entity_id, b.source_file AS target_file FROM e a JOIN e b ON a.norm = b.norm AND a.source_file < b.source_file AND a.id <> b.id)"""
_CLASSIFIED = f"""(SELECT *, CASE WHEN (contains(source_file, '.dtsx') AND contains(target_file, '.sql')) OR (contains(source_file, '.sql') AND contains(target_file, '.dtsx')) THEN 'FEEDS_INTO' ELSE 'SEMANTICALLY_EQUIVALENT_TO' END AS relationship_type, CAST(0.7 AS DOUBLE) AS confidence FROM {_PAIRS} q)"""
SHARED_ENTITIES = f"SELECT norm, relationship_type, count(*) AS pairs, count(DISTINCT source_file) AS source_files FROM {_CLASSIFIED} c GROUP BY 1, 2 ORDER BY pairs DESC, norm, relationship_type LIMIT 10"


def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return discovery.candidate_pairs(part_entities(spark, d)).groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("norm").alias("names"))


def classify_pairs(spark: SparkSession, d: str) -> DataFrame:
    return discovery.classified(discovery.candidate_pairs(part_entities(spark, d))).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("pairs"), F.max("confidence").alias("confidence"))


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    return discovery.shared_names(part_entities(spark, d))


SHARED_NAMES = rf"SELECT norm, count(DISTINCT source_file) AS files, count(DISTINCT id) AS entities FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS norm FROM {PART_ENTITIES_SQL} p) GROUP BY norm HAVING count(DISTINCT source_file) >= 2"


def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    """Relations with a value as confidence, without the doubtful and the unrelated."""
    seen = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.upper("event_type")).alias("relationship_type"), F.round(F.col("value") / 100, 4).alias("confidence"))
    return discovery.confirmed(seen)


THRESHOLD_FILTER = "SELECT event_id, upper(event_type) AS relationship_type, round(value / 100, 4) AS confidence FROM events WHERE event_type <> 'error' AND round(coalesce(value, 0) / 100, 4) >= 0.6"


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = nodes(spark, d)
    return found.select("id", T.node_label(F.col("label")).alias("label"), T.display_label(F.col("id")).alias("shown"), "source_file")


GRAPH_NODES = f"""SELECT id, CASE WHEN lower(label) IN ('report') THEN 'Report' ELSE 'Entity' END AS label, CASE WHEN length(split_part(id, ':', 2)) > 22 THEN substr(split_part(id, ':', 2), 1, 20) || '...' ELSE split_part(id, ':', 2) END AS shown, source_file FROM {NODES_SQL} n"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    kind, name = T.parsed_id(F.col("dst"))
    return edges(spark, d).select("src", T.edge_type(F.lower(F.replace("type", F.lit("_"), F.lit(" ")))).alias("type"), kind.alias("dst_type"), name.alias("dst_name"))


GRAPH_EDGES = f"SELECT src, type, split_part(dst, ':', 1) AS dst_type, split_part(dst, ':', 2) AS dst_name FROM {EDGES_SQL} e"


def edge_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges within the sub-graph of orders, places and the customers whose balance is not negative."""
    some = nodes(spark, d).filter("label IN ('ORDER', 'NATION', 'REGION')").select("id")
    solvent = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.concat(F.lit("CUSTOMER:"), "c_custkey").alias("id"))
    return graph.within(edges(spark, d), some.unionByName(solvent))


EDGE_SEMI_JOIN = f"WITH s AS (SELECT id FROM {NODES_SQL} n WHERE label IN ('ORDER', 'NATION', 'REGION') UNION ALL SELECT 'CUSTOMER:' || c_custkey FROM customer WHERE c_acctbal >= 0) SELECT src, type, dst FROM {EDGES_SQL} e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)"


def entity_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of users: each property from the last event that has it."""
    seen = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return graph.upsert_nodes(seen, "user_id", "event_id", ["event_type", "value"])


ENTITY_UPSERT = "SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS event_type, arg_max(value, event_id) FILTER (WHERE value > 10) AS value FROM events GROUP BY user_id"


def edge_upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Ends of edges that are no node yet are made from their ids; nodes keep what they have."""
    some = nodes(spark, d).filter("label IN ('ORDER', 'CUSTOMER')").select("id", "label", "name")
    return graph.endpoints(edges(spark, d), some)


EDGE_UPSERT = f"""WITH n AS (SELECT id, label, name FROM {NODES_SQL} a WHERE label IN ('ORDER', 'CUSTOMER')), m AS (SELECT DISTINCT id, split_part(id, ':', 1) AS l, split_part(id, ':', 2) AS nm FROM (SELECT src AS id FROM {EDGES_SQL} e UNION SELECT dst FROM {EDGES_SQL} e))
SELECT coalesce(n.id, m.id) AS id, coalesce(label, l) AS label, coalesce(name, nm) AS name FROM n FULL JOIN m ON n.id = m.id"""


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """One edge for an order and a part, with the quantity of the last line."""
    seen = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    made = seen.select(F.concat(F.lit("ORDER:"), "l_orderkey").alias("src"), F.lit("USES").alias("type"), F.concat(F.lit("PART:"), "l_partkey").alias("dst"), "l_linenumber", "quantity")
    return graph.upsert_edges(made, "l_linenumber")


EDGE_MERGE = "SELECT 'ORDER:' || l_orderkey AS src, 'USES' AS type, 'PART:' || l_partkey AS dst, arg_max(q, l_linenumber) AS quantity FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey, l_partkey"


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).groupBy(F.lit("node").alias("what"), F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges(spark, d).groupBy(F.lit("edge").alias("what"), F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


GRAPH_STATS = f"SELECT 'node' AS what, label AS kind, count(*) AS n FROM {NODES_SQL} a GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM {EDGES_SQL} b GROUP BY type"


def degree_top10(spark: SparkSession, d: str) -> DataFrame:
    top = graph.degrees(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(10)
    return top.join(nodes(spark, d).select("id", "label", "name"), "id")


DEGREE_TOP10 = f'SELECT t.id, degree, label, name FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {EDGES_SQL} a UNION ALL SELECT dst FROM {EDGES_SQL} b) GROUP BY id ORDER BY degree DESC, id LIMIT 10) t JOIN {NODES_SQL} n ON t.id = n.id'


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.lower("source_file").isin("region", "nation"), "place").when(F.lower("source_file").isin("customer", "supplier"), "party").otherwise("thing")
    return nodes(spark, d).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


TYPE_DISTRIBUTION = f"SELECT CASE WHEN source_file IN ('region', 'nation') THEN 'place' WHEN source_file IN ('customer', 'supplier') THEN 'party' ELSE 'thing' END AS family, count(*) AS n, count(DISTINCT label) AS labels FROM {NODES_SQL} n GROUP BY 1"


def neighbourhood_2hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(edges(spark, d, once=False), _starts(spark), 2)


NEIGHBOURHOOD = f"""WITH l AS (SELECT DISTINCT "at", "to" FROM {SYMMETRIC_SQL} s), h1 AS (SELECT s.id AS start, l."to" AS id FROM {_STARTS_SQL} s JOIN l ON s.id = l."at"), h2 AS (SELECT start, l."to" AS id FROM h1 JOIN l ON h1.id = l."at")
SELECT DISTINCT start, id FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE start <> id"""


def lineage_3hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage(edges(spark, d, once=False), _starts(spark).filter("id LIKE 'ORDER%'"), _LINEAGE, 3)


LINEAGE = f"""WITH RECURSIVE l AS (SELECT "at", "to", src || '>' || type || '>' || dst AS e FROM {SYMMETRIC_SQL} s WHERE type IN ({', '.join(repr(t) for t in _LINEAGE)})),
p AS (SELECT id AS start, id, [] :: VARCHAR[] AS path, 0 AS hops FROM {_STARTS_SQL} s WHERE id LIKE 'ORDER%' UNION ALL SELECT p.start, l."to", list_append(p.path, l.e), p.hops + 1 FROM p JOIN l ON p.id = l."at" AND NOT list_contains(p.path, l.e) WHERE p.hops < 3)
SELECT start, id, min(hops) AS hops FROM p WHERE hops > 0 GROUP BY start, id"""


def search_union(spark: SparkSession, d: str) -> DataFrame:
    """Names of nodes that hold a term, at most ten of each label; edges are not searched."""
    n, out = nodes(spark, d), None
    for term in ("ring", "nation_1", "supplier#00000001"):
        hits = n.filter(graph.holds([F.col("name")], term)).select(F.lit(term).alias("term"), F.col("label").alias("branch"), "id", "name")
        out = hits if out is None else out.unionByName(hits)
    order = W.partitionBy("term", "branch").orderBy("name", "id")
    return out.dropDuplicates(["term", "branch", "name"]) .withColumn("n", F.row_number().over(order)).filter("n <= 10").select("term", "branch", "name", "n")


SEARCH_UNION = f"""SELECT term, branch, name, CAST(n AS INTEGER) AS n FROM (SELECT term, label AS branch, name, row_number() OVER (PARTITION BY term, label ORDER BY name) AS n FROM (SELECT DISTINCT term, label, name FROM {NODES_SQL} x JOIN (SELECT unnest(['ring', 'nation_1', 'supplier#00000001']) AS term) t ON contains(lower(name), term))) WHERE n <= 10"""


def subgraph_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return graph.by_suffix(edges(spark, d), ("n:3", "R:11"))


SUBGRAPH_BY_SUFFIX = f"SELECT src, type, dst FROM {EDGES_SQL} e WHERE lower(src) LIKE '%n:3' OR lower(dst) LIKE '%n:3' OR lower(src) LIKE '%r:11' OR lower(dst) LIKE '%r:11'"


def node_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """The sub-graph of places."""
    return graph.of_type(nodes(spark, d), edges(spark, d), ["region", "nation"])[1]


NODE_TYPE_FILTER = f"SELECT src, type, dst FROM {EDGES_SQL} e WHERE split_part(src, ':', 1) IN ('REGION', 'NATION') AND split_part(dst, ':', 1) IN ('REGION', 'NATION')"


def range_containment_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines within the extents of paragraphs."""
    from graphloom.plans.text_queries import section_extents

    units = section_extents(spark, d).select("doc_id", F.col("start").alias("unit_start"), F.col("end").alias("unit_end"))
    lines = windows.lines_of(table(spark, d, "documents"), "doc_id", "text").filter("length(line) > 0").select("doc_id", F.col("line_number").alias("start"), F.col("line_number").alias("end"), F.length("line").alias("chars"))
    return joins.contained(lines, units, "doc_id").groupBy("doc_id", "unit_start", "unit_end").agg(F.count(F.lit(1)).alias("lines"), F.sum("chars").alias("chars"))


def _containment_sql() -> str:
    from graphloom.plans.text_queries import _LINES, SECTION_EXTENTS

    return f'SELECT u.doc_id, u.start AS unit_start, u."end" AS unit_end, count(*) AS lines, CAST(sum(length(l.line)) AS BIGINT) AS chars FROM ({SECTION_EXTENTS}) u JOIN {_LINES} l ON l.doc_id = u.doc_id AND l.line_number BETWEEN u.start AND u."end" WHERE length(l.line) > 0 GROUP BY 1, 2, 3'


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = _points(spark, d).filter("id IN (1, 2, 3, 4, 5)").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.top_k(_points(spark, d), asked)


def cosine_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked = _points(spark, d).filter("id IN (1, 2, 3, 4, 5)").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.top_k(_points(spark, d), asked, where=F.col("label") == 3)


def _topk_sql(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (1, 2, 3, 4, 5)), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q WHERE {where})
SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5"""


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (shared_entities, SHARED_ENTITIES), (blocked_pairs, f"SELECT source_file, target_file, count(*) AS pairs, count(DISTINCT norm) AS names FROM {_PAIRS} p GROUP BY 1, 2"),
        (classify_pairs, f"SELECT relationship_type, count(*) AS pairs, max(confidence) AS confidence FROM {_CLASSIFIED} c GROUP BY 1"), (shared_names, SHARED_NAMES), (threshold_filter, THRESHOLD_FILTER),
        (graph_nodes, GRAPH_NODES), (graph_edges, GRAPH_EDGES), (edge_semi_join, EDGE_SEMI_JOIN), (entity_upsert_last_wins, ENTITY_UPSERT), (edge_upsert_coalesce, EDGE_UPSERT), (edge_merge, EDGE_MERGE),
        (graph_stats, GRAPH_STATS), (degree_top10, DEGREE_TOP10), (type_distribution, TYPE_DISTRIBUTION), (neighbourhood_2hop, NEIGHBOURHOOD), (lineage_3hop, LINEAGE), (search_union, SEARCH_UNION),
        (subgraph_by_suffix, SUBGRAPH_BY_SUFFIX), (node_type_filter, NODE_TYPE_FILTER), (range_containment_join, _containment_sql()), (cosine_topk, _topk_sql("true")), (cosine_topk_filtered, _topk_sql("label = 3")),
    )
}

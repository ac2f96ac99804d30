"""A property graph and its packages as bucketed Parquet tables, into which batches of packages are merged, each once.

Tables lie in folders of buckets by the hash of their key. A batch works out the new content of the buckets it touches and writes
it aside; then a mark says that it is prepared, the buckets are overwritten, and a second mark ends it. Whatever is killed before
the first mark leaves the tables as they were; after it, the next call overwrites the buckets again from what lies aside. A batch
with the second mark is passed over, so a stream may hand a batch over as often as it likes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import content_key, edge_type, node_label, parsed_id
from graphloom.session import with_checkpoints

MAP = "map<string,string>"
#: Columns of packages; nodes and edges may be empty, then entities and relationships stand in for them.
PACKAGE = (
    "file_name string, source_type string, file_path string, purpose string, business_domain string, total_lines bigint, size_bytes bigint, confidence double, text string,"
    f" nodes array<struct<id:string,label:string,properties:{MAP}>>, edges array<struct<source_id:string,target_id:string,type:string,properties:{MAP}>>,"
    " entities array<struct<name:string,entity_type:string>>, relationships array<struct<source:string,target:string,relationship_type:string>>,"
    " business_rules array<string>, transformations array<struct<rule_id:string,rule_type:string,description:string,expression:string,confidence:double>>"
)
#: Tables of a store and their keys.
KEYS = {"artifacts": ["id"], "entities": ["id"], "edges": ["src", "type", "dst"], "rules": ["id"], "transformations": ["id"], "packages": ["file_name", "content_key"]}


def _artifact(c: Column) -> Column:
    return F.concat(F.lit("ARTIFACT:"), c)


def _nodes(packages: DataFrame) -> DataFrame:
    """Nodes of each package in order; of its entities, where it tells no nodes."""
    made = F.transform("entities", lambda e: F.struct(F.concat(F.upper(F.coalesce(e["entity_type"], F.lit("Entity"))), F.lit(":"), F.coalesce(e["name"], F.lit(""))).alias("id"), F.coalesce(e["entity_type"], F.lit("Entity")).alias("label"), F.create_map(F.lit("name"), F.coalesce(e["name"], F.lit("")), F.lit("entity_type"), F.coalesce(e["entity_type"], F.lit("Entity"))).alias("properties")))
    told = F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(made)
    return packages.select("file_name", F.posexplode(told).alias("at", "n")).select("file_name", "at", F.coalesce("n.id", F.lit("")).alias("id"), node_label(F.coalesce("n.label", F.lit("Entity"))).alias("label"), "n.properties")


def _edges(packages: DataFrame) -> DataFrame:
    """Edges of each package in order; of its relationships, where it tells no edges."""
    made = F.transform("relationships", lambda r: F.struct(r["source"].alias("source_id"), r["target"].alias("target_id"), r["relationship_type"].alias("type"), F.lit(None).cast(MAP).alias("properties")))
    told = F.when(F.size("edges") > 0, F.col("edges")).otherwise(made)
    out = packages.select("file_name", F.posexplode(told).alias("at", "e"))
    return out.select("file_name", "at", F.coalesce("e.source_id", F.lit("")).alias("src"), edge_type(F.coalesce("e.type", F.lit("RELATES_TO"))).alias("type"), F.coalesce("e.target_id", F.lit("")).alias("dst"), "e.properties")


def _last_properties(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One map a key, each property of its last observation by file and place: counted down by property before maps are made."""
    each = rows.select(*keys, "file_name", "at", F.explode("properties").alias("p", "v"))
    last = each.groupBy(*keys, "p").agg(F.max_by("v", F.struct("file_name", "at")).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("properties"))


def _known(c: str) -> Column:
    return F.coalesce(c, F.create_map().cast(MAP))


def _joined(new: DataFrame, old: DataFrame, keys: list[str], merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Rows of either side; of columns in both sides' rows what ``merge`` says, the new value if it says nothing."""
    rest = [c for c in new.columns if c not in keys]
    renamed = old.select(*[F.col(k).alias(f"old {k}") for k in keys], *[F.col(c).alias(f"old {c}") for c in rest])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"old {k}")) for k in keys])
    full = new.withColumn("is new", F.lit(True)).join(renamed, same, "full_outer")
    take = lambda c: F.when(F.col("is new").isNull(), F.col(f"old {c}")).otherwise(merge.get(c, lambda n, o: n)(F.col(c), F.col(f"old {c}")))
    return full.select(*[F.when(F.col("is new").isNull(), F.col(f"old {k}")).otherwise(F.col(k)).alias(k) for k in keys], *[take(c).alias(c) for c in rest])


def _both(n: Column, o: Column) -> Column:
    """Properties of two maps, the new before the old."""
    new, old = F.coalesce(n, F.create_map().cast(MAP)), F.coalesce(o, F.create_map().cast(MAP))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def changes(packages: DataFrame) -> dict[str, tuple[DataFrame, dict]]:
    """What a batch of packages brings to each table, and how its columns meet those that are there.

    Packages follow each other by file name. Artifacts, rules and transformations are replaced; entities and edges take over the
    properties that they are told anew. An end of an edge that is told by no node takes name and type from its id, unless it has them.
    """
    artifact = _artifact(F.col("file_name"))
    text, of = F.coalesce("text", F.lit("")), F.coalesce
    artifacts = packages.select(artifact.alias("id"), "file_name", "source_type", of("file_path", F.lit("")).alias("file_path"), of("purpose", F.lit("")).alias("purpose"), of("business_domain", F.lit("General")).alias("business_domain"), of("total_lines", F.lit(0)).alias("total_lines"), of("size_bytes", F.lit(0)).alias("size_bytes"), of("confidence", F.lit(0.9)).alias("overall_confidence"))
    nodes, edges = _nodes(packages), _edges(packages)

    last = nodes.groupBy("id").agg(F.max_by("label", F.struct("file_name", "at")).alias("entity_label"), F.max("file_name").alias("source_file"))
    told = last.join(_last_properties(nodes, ["id"]), "id", "left")
    told = told.select("id", F.col("properties")["name"].alias("name"), F.col("properties")["entity_type"].alias("entity_type"), "entity_label", "source_file", "properties")
    ends = edges.select(F.col("src").alias("id"), F.col("file_name")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(None).cast("string").alias("file_name")))
    kind, name = parsed_id(F.col("id"))
    ends = ends.groupBy("id").agg(F.min("file_name").alias("source_file")).select("id", name.alias("end_name"), kind.alias("end_type"), F.col("source_file").alias("end_file"))
    entities = told.join(ends, "id", "full_outer")

    artifact_edges = lambda rows, kind, dst: rows.select("file_name", artifact.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), F.lit(None).cast(MAP).alias("properties"), F.lit(-1).alias("at"))
    rules = packages.select("file_name", F.posexplode("business_rules").alias("rule_index", "description"))
    rule_id = F.concat_ws(":", F.lit("RULE"), "file_name", "rule_index")
    steps = packages.select("file_name", F.posexplode("transformations").alias("at", "t"))
    step_id = F.concat(F.lit("TRANSFORM:"), F.col("file_name"), F.lit(":"), F.coalesce("t.rule_id", F.lit("")))
    every = reduce(DataFrame.unionByName, [edges, artifact_edges(nodes, "CONTAINS", F.col("id")), artifact_edges(rules, "HAS_RULE", rule_id), artifact_edges(steps, "HAS_TRANSFORMATION", step_id)])
    keys = KEYS["edges"]
    merged = every.groupBy(*keys).agg(F.max("file_name").alias("source_file")).join(_last_properties(every, keys), keys, "left")
    made = steps.groupBy(step_id.alias("id")).agg(F.max_by("t", "at").alias("t"), F.max("file_name").alias("source_file"))
    documents = packages.select("file_name", content_key(text).alias("content_key"), F.to_json(F.struct(*[c for c in packages.columns if c != "text"])).alias("document"))
    keep = lambda n, o: F.coalesce(n, o)
    return {
        "artifacts": (artifacts, {}),
        "entities": (entities, {"name": keep, "entity_type": keep, "entity_label": keep, "source_file": keep, "properties": _both}),
        "edges": (merged, {"properties": _both}),
        "rules": (rules.select(rule_id.alias("id"), "description", F.col("file_name").alias("source_file"), "rule_index"), {}),
        "transformations": (made.select("id", "t.rule_id", "t.rule_type", "t.description", "t.expression", "source_file", F.coalesce("t.confidence", F.lit(1.0)).alias("confidence")), {}),
        "packages": (documents, {}),
    }


class MergedTables:
    """Tables of partitions under a folder that driver and executors share, changed by batches that are prepared, overwritten and committed."""

    #: The tables, and the column that they are partitioned by.
    tables: tuple[str, ...] = ()
    part = "bucket"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._file(path)
        return fs.exists(target)

    def _parts(self, path: str) -> set[str]:
        """Folders of the partitions that a table has files of."""
        fs, target = self._file(path)
        names = {s.getPath().getName() for s in fs.listStatus(target)} if fs.exists(target) else set()
        return {n for n in names if n.startswith(f"{self.part}=")}

    def _mark(self, batch: int, state: str) -> None:
        fs, target = self._file(f"{self.path}/log/{batch}.{state}")
        fs.create(target, True).close()

    def _state(self, batch: int) -> str:
        return next((s for s in ("committed", "prepared") if self._exists(f"{self.path}/log/{batch}.{s}")), "new")

    def table(self, name: str) -> DataFrame | None:
        """A table of the store; None before its first batch."""
        path = f"{self.path}/{name}"
        return self.spark.read.parquet(path).drop(self.part) if self._parts(path) else None

    def _set_aside(self, batch: int, name: str, rows: DataFrame) -> None:
        rows.repartition(self.part).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/aside/{batch}/{name}")

    def _overwrite(self, batch: int) -> None:
        for name in self.tables:
            if self._parts(f"{self.path}/aside/{batch}/{name}"):
                rows = self.spark.read.parquet(f"{self.path}/aside/{batch}/{name}")
                rows.repartition(self.part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(f"{self.path}/{name}")
        self._finish(batch)
        self._mark(batch, "committed")
        fs, target = self._file(f"{self.path}/aside/{batch}")
        fs.delete(target, True)

    def _finish(self, batch: int) -> None:
        """What else a batch does before it is committed; it may be done twice."""

    def recover(self) -> None:
        """End the batch that was prepared but not committed, if there is one."""
        if self._exists(f"{self.path}/log"):
            fs, target = self._file(f"{self.path}/log")
            for status in fs.listStatus(target):
                batch, _, state = status.getPath().getName().rpartition(".")
                if state == "prepared" and self._state(int(batch)) == "prepared":
                    self._overwrite(int(batch))


class GraphStore(MergedTables):
    """Artifacts, entities, edges, rules, transformations and packages, in buckets by the hash of their keys."""

    tables = tuple(KEYS)

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        super().__init__(spark, path)
        self.buckets = buckets

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _prepare(self, batch: int, name: str, new: DataFrame, merge: dict) -> None:
        keys = KEYS[name]
        new = new.withColumn("bucket", self._bucket(keys))
        path = f"{self.path}/{name}"
        if name == "entities":
            new = new.select("id", "name", "entity_type", "entity_label", "source_file", "properties", "end_name", "end_type", "end_file", "bucket")
        if self._parts(path):
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # one number a bucket at most
            old = self.spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        else:
            old = self.spark.createDataFrame([], new.drop("end_name", "end_type", "end_file").schema)
        if name == "entities":
            ends = new.select("id", "end_name", "end_type", "end_file")
            whole = _joined(new.drop("end_name", "end_type", "end_file"), old, keys, merge).join(ends, "id", "left")
            whole = whole.select("id", F.coalesce("name", "end_name").alias("name"), F.coalesce("entity_type", "end_type").alias("entity_type"), "entity_label", F.coalesce("source_file", "end_file").alias("source_file"), _known("properties").alias("properties"), "bucket")
        else:
            whole = _joined(new, old, keys, merge)
        self._set_aside(batch, name, whole)

    def merge(self, packages: DataFrame, batch: int) -> bool:
        """Merge a batch of packages; False if that batch has been merged before. Batches come one after another."""
        self.recover()
        if self._state(batch) == "committed":
            return False
        with_checkpoints(self.spark)
        packages = packages.checkpoint()  # six tables are made of it
        for name, (new, how) in changes(packages).items():
            self._prepare(batch, name, new, how)
        self._mark(batch, "prepared")
        self._overwrite(batch)
        return True

    def load(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge a stream of packages, batch by batch."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.merge(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Batches merged into a store: once, in order, whatever is killed on the way; against a loader in plain Python."""

import json

import pytest

from graphloom.sources.graph_store import KEYS, PACKAGE, GraphStore


def package(name, nodes=(), edges=(), entities=(), relationships=(), rules=(), steps=(), text="x"):
    return (name, "sql", None, f"purpose of {name}", None, 3, None, None, text, [tuple(n) for n in nodes], [tuple(e) for e in edges], list(entities), list(relationships), list(rules), list(steps))


BATCHES = [
    [
        package("a.sql", nodes=[("TABLE:t", "table", {"name": "t", "x": "1"}), ("COLUMN:t.c", "column", {"name": "t.c"})], edges=[("TABLE:t", "TABLE:u", "reads from", {"p": "1"}), ("plain", "TABLE:t", "USES", None)], rules=["first", "second"], steps=[("R1", "CASE", "d", "e", None)]),
        package("b.sql", entities=[("v", "view")], relationships=[("TABLE:t", "VIEW:v", None)]),
        package("c.sql"),
    ],
    [
        package("a.sql", nodes=[("TABLE:t", "table", {"x": "2", "y": "3"}), ("TABLE:u", "odd", {"name": "U"})], edges=[("TABLE:t", "TABLE:u", "READS FROM", {"q": "2"})], rules=["changed"], text="y"),
        package("d.sql", nodes=[("TABLE:t", "table", {"x": "4"})], edges=[("TABLE:new", "TABLE:t", "USES", {"z": "5"})]),
    ],
]


def brute(batches):
    """The graph after loading package by package, six steps each."""
    artifacts, entities, edges, rules, steps = {}, {}, {}, {}, {}
    for p in (p for batch in batches for p in sorted(batch)):
        name, art = p[0], f"ARTIFACT:{p[0]}"
        artifacts[art] = (name, p[3])
        nodes = p[9] or [(f"{t.upper()}:{n}", t, {"name": n, "entity_type": t}) for n, t in p[11]]
        for i, label, props in nodes:
            e = entities.setdefault(i, {"properties": {}})
            e["properties"] |= props
            e |= {k: props[k] for k in ("name", "entity_type") if k in props} | {"source_file": name}
            edges.setdefault((art, "CONTAINS", i), {"properties": {}})["source_file"] = name
        for s, d, kind, props in p[10] or [(s, d, k, None) for s, d, k in p[12]]:
            for i, file in ((s, name), (d, None)):
                e = entities.setdefault(i, {"properties": {}})
                kind_, _, rest = i.partition(":")
                made = {"name": rest or kind_, "entity_type": kind_ if rest else "Entity", "source_file": file}
                for k, v in made.items():
                    if e.get(k) is None:
                        e[k] = v
            e = edges.setdefault((s, (kind or "RELATES_TO").upper().replace(" ", "_"), d), {"properties": {}})
            e["properties"] |= props or {}
            e["source_file"] = name
        for k, r in enumerate(p[13]):
            rules[f"RULE:{name}:{k}"] = r
            edges.setdefault((art, "HAS_RULE", f"RULE:{name}:{k}"), {"properties": {}})["source_file"] = name
        for t in p[14]:
            steps[f"TRANSFORM:{name}:{t[0]}"] = t[3]
            edges.setdefault((art, "HAS_TRANSFORMATION", f"TRANSFORM:{name}:{t[0]}"), {"properties": {}})["source_file"] = name
    return artifacts, entities, edges, rules, steps


def held(store):
    rows = lambda name: [r.asDict() for r in store.table(name).collect()]
    return (
        {r["id"]: (r["file_name"], r["purpose"]) for r in rows("artifacts")},
        {r["id"]: {k: r[k] for k in ("name", "entity_type", "source_file", "properties")} for r in rows("entities")},
        {(r["src"], r["type"], r["dst"]): {"properties": r["properties"] or {}, "source_file": r["source_file"]} for r in rows("edges")},
        {r["id"]: r["description"] for r in rows("rules")},
        {r["id"]: r["expression"] for r in rows("transformations")},
    )


def wanted(batches):
    artifacts, entities, edges, rules, steps = brute(batches)
    return artifacts, {i: {k: e.get(k) for k in ("name", "entity_type", "source_file", "properties")} for i, e in entities.items()}, edges, rules, steps


@pytest.fixture
def frames(spark):
    return [spark.createDataFrame(b, PACKAGE) for b in BATCHES]


def test_batches_as_a_loader_would(spark, tmp_path, frames):
    store = GraphStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.table("edges") is None
    assert store.merge(frames[0], 0) and held(store) == wanted(BATCHES[:1])
    assert store.merge(frames[1], 1) and held(store) == wanted(BATCHES)
    assert not store.merge(frames[0], 0) and held(store) == wanted(BATCHES)
    documents = {(r["file_name"], json.loads(r["document"])["purpose"]) for r in store.table("packages").collect()}
    assert len(store.table("packages").collect()) == 5 and ("a.sql", "purpose of a.sql") in documents


@pytest.mark.parametrize("after", ["edges", "prepared", "overwritten entities"])
def test_a_killed_batch_run_again(spark, tmp_path, frames, monkeypatch, after):
    store = GraphStore(spark, str(tmp_path / "s"), buckets=4)
    store.merge(frames[0], 0)
    if after == "prepared":
        monkeypatch.setattr(GraphStore, "_overwrite", lambda self, batch: (_ for _ in ()).throw(KeyboardInterrupt()))
    elif after.startswith("overwritten"):
        last = after.split()[1]

        def overwrite(self, batch):
            for name in KEYS:
                if self._parts(f"{self.path}/aside/{batch}/{name}"):
                    rows = spark.read.parquet(f"{self.path}/aside/{batch}/{name}")
                    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
                if name == last:
                    raise KeyboardInterrupt

        monkeypatch.setattr(GraphStore, "_overwrite", overwrite)
    else:
        prepare = GraphStore._prepare

        def dying(self, batch, name, new, merge):
            prepare(self, batch, name, new, merge)
            if name == after:
                raise KeyboardInterrupt

        monkeypatch.setattr(GraphStore, "_prepare", dying)
    with pytest.raises(KeyboardInterrupt):
        store.merge(frames[1], 1)
    monkeypatch.undo()
    if not after.startswith("overwritten"):
        assert held(store) == wanted(BATCHES[:1])  # nothing of it is seen
    again = GraphStore(spark, str(tmp_path / "s"), buckets=4)
    again.merge(frames[1], 1)
    assert held(again) == wanted(BATCHES)
    assert not again.merge(frames[1], 1)


def test_stream_of_packages(spark, tmp_path, frames):
    frames[0].unionByName(frames[1].limit(0)).write.json(str(tmp_path / "in"))
    store = GraphStore(spark, str(tmp_path / "s"), buckets=4)
    store.load(spark.readStream.schema(PACKAGE).json(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    assert held(store) == wanted(BATCHES[:1])

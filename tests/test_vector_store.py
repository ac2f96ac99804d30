"""A stored set of points against brute force, before and after points are replaced."""

import numpy as np
import pytest

from graphloom.sources.vector_store import VectorStore

SCHEMA = "id bigint, vector array<double>"


def frame(spark, points):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in points], SCHEMA).repartition(3)


def brute(points, queries, k):
    own = {i: np.array(v) / np.linalg.norm(v) for i, v in points.items()}
    return {q: sorted(own, key=lambda i: (round(float(np.linalg.norm(own[i] - np.array(v) / np.linalg.norm(v))), 12), i))[:k] for q, v in queries.items()}


def got(store, spark, queries, k=4):
    out = {}
    for r in store.search(frame(spark, queries.items()).withColumnRenamed("id", "query_id"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_nearest_after_upserts(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 3
    points = {i: (centres[i % 6] + rng.normal(size=5)).tolist() for i in range(300)}
    points |= {i: points[0] for i in range(300, 320)}  # copies
    queries = {1000 + i: rng.normal(size=5).tolist() for i in range(15)} | {0: points[0]}
    store = VectorStore(spark, str(tmp_path / "v"), cells=12)
    assert store.upsert(frame(spark, points.items()), 0)
    assert got(store, spark, queries) == brute(points, queries, 4)
    moved = {i: [-x for x in points[i]] for i in range(0, 320, 3)} | {900: points[7]}
    assert store.upsert(frame(spark, moved.items()), 1) and not store.upsert(frame(spark, moved.items()), 1)
    assert got(store, spark, queries) == brute(points | moved, queries, 4)
    assert store.table("points").count() == 321


def test_a_cell_that_all_points_leave(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), cells=2)
    store.upsert(frame(spark, [(1, [1, 0]), (2, [0, 1])]), 0)
    store.upsert(frame(spark, [(2, [1, 0.1])]), 1)
    assert got(store, spark, {5: [0.0, 1.0]}) == {5: [2, 1]} and store.table("points").count() == 2


@pytest.mark.parametrize("points", [[], [(1, None), (None, [1, 2])], [(1, [0, 0]), (2, [float("nan"), 1])]])
def test_nothing_to_store(spark, tmp_path, points):
    assert not VectorStore(spark, str(tmp_path / "v")).upsert(frame(spark, points), 0)

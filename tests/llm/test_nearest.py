"""Neighbours against brute force."""

import numpy as np

from graphloom.llm.nearest import nearest_neighbours
from graphloom.llm.shared import table


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def test_recall_on_the_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = df.collect()
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float))
    got = {}
    for r in nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all([s for _, s in r] == sorted(s for _, s in r) for r in got.values())


def test_nothing_is_lost_in_hot_clusters(spark):
    """A third near copies of one vector and some exact ones of another, each more than are reranked."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3600, 16))
    x[::3] = x[0] + 1e-4 * rng.normal(size=(1200, 16))
    x[1:2400:6] = x[1]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    want = brute(np.arange(len(x)), x, every=20)
    got = {}
    for r in nearest_neighbours(df, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [v for v, _ in near] for q, near in want.items()}


def test_blocks_of_queries(spark, monkeypatch):
    """Many blocks give what one does."""
    from graphloom.llm import nearest

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(400, 6)).tolist())], "vec_id bigint, embedding array<double>")
    one = sorted(map(tuple, nearest_neighbours(df, every=5).collect()))
    monkeypatch.setattr(nearest, "query_block", lambda dims: 30)
    assert sorted(map(tuple, nearest_neighbours(df, every=5).collect())) == one
    assert nearest.query_block.__name__ == "<lambda>" and len(one) == 800


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0] * 3), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [1.0]), (0, [3.0, 3.0, 3.0]), (100, [5.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3.0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score double, rank int")
    got = [tuple(r) for r in nearest_neighbours(df).orderBy("rank").collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 2**0.5), (100, 1, 9, 4.0)]
    assert nearest_neighbours(df.limit(0)).collect() == []
    assert nearest_neighbours(df.filter("vec_id = 0")).collect() == []

"""Links of three-word shingle sets against all pairs."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa

import graphloom.llm.jaccard_join as jaccard
from graphloom.llm.jaccard_join import OP11_SQL, bitmap, jaccard_components, shingle_set, window_of


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(docs):
    """(doc_id, n_shingles, component) by comparing every two rows with an id."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 90 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def check(df):
    got = jaccard_components(df).collect()
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(docs)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and len(got) == len(docs)
    return got


def test_whole_table(documents, sf_dir):
    got = check(documents)
    assert any(r["component_id"] != r["doc_id"] for r in got)
    want = duckdb.sql(OP11_SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    assert sorted(want) == sorted(map(tuple, got))


def families(rng, count, steps, length, first=0):
    """Chains of texts, each a little further from the first, and a passage that many of them share."""
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    for family in range(count):
        text = [rng.choice(words) for _ in range(length)]
        for step in range(steps):
            yield first + 1000 * family + step, (passage + " " if family % 2 else "") + " ".join(text)
            text[rng.randrange(length)] = rng.choice(words)


def test_chains_copies_and_the_very_threshold(spark):
    rng = random.Random(5)
    docs = list(families(rng, 6, 14, 120))
    base = [f"t{k}" for k in range(20)]  # 18 shingles, of which 18 of 20 are shared, then 18 of 21
    docs += [(10000, " ".join(base)), (10001, " ".join([*base, "a", "b"])), (10002, " ".join([*base, "p", "q", "r"]))]
    docs += [(20000 + k, "Two Words" if k % 2 else "two WORDS") for k in range(300)]
    check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7))


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert {r["body"] for r in jaccard_components(odd_docs, carry=("body",)).collect()} == {"y"}


def test_an_id_with_several_texts(spark):
    rng = random.Random(6)
    docs = list(families(rng, 4, 12, 60))
    docs += [(7, docs[k][1]) for k in (3, 15, 40)] + [(8, docs[40][1]), (8, "something else"), (8, docs[20][1])]
    check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))


def test_no_rows(no_docs):
    assert jaccard_components(no_docs).collect() == []


def test_windows_and_bitmaps_miss_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.choice([rng.integers(1, 400), rng.integers(900, 5000)]))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * rng.uniform(0.85, 1)))], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 15) + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        apart = jaccard.apart_at_least(bitmap(x), bitmap(y))
        assert apart <= len(x) + len(y) - 2 * both
        if 100 * both >= 90 * (len(x) + len(y) - both):
            assert set(x[: window_of(len(x))]) & set(y[: window_of(len(y))])
            assert jaccard._may_reach(len(x), len(y), apart, 90)


def test_regions_of_a_cell_find_all_components():
    """Cells larger than a leaf: recursion around pivots, against all pairs."""
    rng = random.Random(8)
    texts = [t for _, t in families(rng, 40, 12, 80)]
    sets = [shingle_set(t.encode()) for t in texts]
    node = np.arange(len(sets), dtype=np.int64)
    region = jaccard._Region(sets, node, node.copy())
    region.join(node, node)
    want = {d: c for d, _, c in brute(list(enumerate(texts)))}
    groups = {}
    for d in want:
        groups.setdefault(region.find(d), set()).add(d)
    wanted = {}
    for d, c in want.items():
        wanted.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_triangle_windows():
    distance = np.array([0.0, 0.05, 0.12, 0.18, np.nan, -1.0])
    others = np.arange(6)
    assert jaccard._in_windows(4, others, distance).tolist() == [2, 3, 4, 5]
    assert jaccard._in_windows(1, others, distance).tolist() == [0, 1, 2, 5]
    assert jaccard._in_windows(3, others, distance).tolist() == [2, 3, 4, 5]
    assert jaccard._in_windows(5, others, distance).tolist() == [0, 1, 2, 3, 4, 5]


def test_counts_of_tasks_add_up():
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"a b c d", None], pa.binary())], schema=schema)
    rows = [r for b in jaccard._sets(iter([batch])) for r in b.to_pylist()]
    chunks = sorted(((r["chunk"], r["counts"]) for r in rows if r["chunk"] is not None), key=lambda c: c[0])
    table = pa.RecordBatch.from_arrays([pa.array([c for c, _ in chunks + chunks][:: 1], pa.int32()).take(pa.array(sorted(range(2 * len(chunks)), key=lambda i: (chunks + chunks)[i][0]))), pa.array([b for _, b in sorted(chunks + chunks, key=lambda c: c[0])], pa.binary())], ["chunk", "counts"])
    assert sum(np.frombuffer(r["counts"], "<i8").sum() for b in jaccard._added(iter([table])) for r in b.to_pylist()) == 4

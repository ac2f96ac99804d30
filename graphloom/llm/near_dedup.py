"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

Documents with the same shingle set are one node. In a bucket of a band every node is a candidate of the bucket's
smallest node only, so a bucket of n nodes gives n - 1 pairs. Candidates compare their signatures batch by batch; a pair
is dropped once the posterior probability that its similarity reaches the threshold is under ``MISS``. Survivors are
confirmed on their full sets. Nodes of a bucket that are then outside the component of the smallest one are compared with
the others block by block: no pair leaves a block but links that join components, so no link is lost and no list of
pairs grows with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import carried, drop_settled, narrow, settle

WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes that are compared before the posterior is looked at again.
BATCH = 32
#: Probability of losing a pair that reaches the threshold.
MISS = 1e-6
#: Nodes and bytes of text of one side that a task compares with another such side.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Buckets of up to so many nodes share cells.
SMALL = 64
#: Cells of a task, where there are more of them than shuffle partitions.
TASK_CELLS = 16
#: Ids that are broadcast at most, to read only texts that are needed; more are joined.
MAX_BROADCAST_IDS = 1_000_000
#: Shingles that are hashed at a time.
SLICE = 2048

_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _rng.integers(1, 2**63, WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; the words of a shorter text make one."""
    words = (text or b"").lower().split()  # on bytes: only A-Z change, only [\x20\x09-\x0D] separate
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64) * WEIGHTS[WORDS]
    for k in range(size):
        h += w[k : len(w) - size + 1 + k] * WEIGHTS[k]
    return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), SLICE):
        h = np.multiply.outer(MULTIPLIERS, shingles[at : at + SLICE])
        h >>= np.uint64(32)
        np.minimum(low, h.min(axis=1).astype(np.uint32), out=low)
    return low


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, hi, lo, sig = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            hi.append(int(_mix(s ^ WEIGHTS[0]).sum(dtype=np.uint64).astype(np.int64)))
            lo.append(int(_mix(s ^ WEIGHTS[1]).sum(dtype=np.uint64).astype(np.int64)))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), *batch.columns[2:]], ["doc_id", "n_shingles", "hi", "lo", "sig", *batch.schema.names[2:]])


def band_keys(sig: np.ndarray) -> np.ndarray:
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        key = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["key", "node"])


def posterior(matches: int, of: int, at_least: float) -> float:
    """P(J >= at_least) after ``matches`` of ``of`` equal hashes, from an even prior: P(Bin(of + 1, at_least) <= matches)."""
    return sum(comb(of + 1, k) * at_least**k * (1 - at_least) ** (of + 1 - k) for k in range(matches + 1))


def _least(at_least: float, miss: float) -> list[int]:
    """For each number of batches, the fewest matches with which a pair is still looked at."""
    return [next(m for m in range(n + 1) if posterior(m, n, at_least) >= miss) for n in range(BATCH, HASHES + 1, BATCH)]


def _survive(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequential test of pairs of signatures, row by row: which survive, and their matches when the test ended."""
    least = _least(THRESHOLD_PERCENT / 100, MISS)
    alive = 100 * np.minimum(n_x, n_y) >= THRESHOLD_PERCENT * np.maximum(n_x, n_y)
    matches = np.zeros(len(x), np.int64)
    on = np.flatnonzero(alive)
    for k in range(HASHES // BATCH):
        matches[on] += (x[on, k * BATCH : (k + 1) * BATCH] == y[on, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
        alive[on] = matches[on] >= least[k]
        on = on[alive[on]]
    return alive, matches


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The survivors among (a, b, sig_a, sig_b, n_a, n_b), with their matches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
        alive, matches = _survive(x, y, np.asarray(batch.column(4)), np.asarray(batch.column(5)))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(i))[alive]) for i in (0, 1)] + [pa.array(matches[alive])], ["a", "b", "matches"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, text_a, text_b) whose full sets reach the threshold."""
    last, held = None, None
    for batch in batches:
        a, b = [], []
        for i, j, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if i != last:
                last, held = i, shingle_set(s.as_py())
            other = shingle_set(t.as_py())
            both = len(np.intersect1d(held, other, assume_unique=True))
            if 100 * both >= THRESHOLD_PERCENT * (len(held) + len(other) - both):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    return full.mapInArrow(_verify, "a bigint, b bigint, matches bigint")


def _needed(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ids are wanted, one of each id."""
    ids = settle(ids.distinct(), "ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``pairs`` (a, b), from the texts of their ids alone."""
    needed = settle(_needed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), texts), "texts")
    side = lambda x: needed.select(F.col("doc_id").alias(x), F.col("body").alias(f"body_{x}"))
    out = settle(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "body_a", "body_b").mapInArrow(_confirm, "a bigint, b bigint").distinct(), "links")
    drop_settled(needed)
    return out


def _buckets_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each bucket of a cell: row numbers, those that are compared, those they are compared with."""
    key = np.asarray(table.column("part"))
    role = np.asarray(table.column("role"))
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        yield rows, rows[role[rows] != 1], rows[role[rows] != 0]


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each compared row of a cell with the rows that it may be linked with and does not share a component with."""
    if not table.num_rows:
        return
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    n, component, key = (np.asarray(table.column(c)) for c in ("n_shingles", "cn", "key"))
    keys = band_keys(sig)
    for _, xs, ms in _buckets_of(table):
        for x in xs:
            m = ms[component[ms] != component[x]]
            band = int(np.flatnonzero(keys[x] == key[x])[0])
            m = m[~(keys[m, :band] == keys[x, :band]).any(axis=1)]  # else met in an earlier band
            if len(m):
                alive, _ = _survive(np.broadcast_to(sig[x], (len(m), HASHES)), sig[m], np.broadcast_to(n[x], len(m)), n[m])
                if alive.any():
                    yield x, m[alive]


def _alive(table: pa.Table) -> pa.Table:
    """The nodes of a cell that may have a link across components."""
    found: set[int] = set()
    for x, m in _candidates(table):
        found.add(int(x))
        found.update(m.tolist())
    rows = np.array(sorted(found), np.int64)
    return pa.table({c: pa.array(np.asarray(table.column(c))[rows]) for c in ("key", "node")})


def _joining(table: pa.Table) -> pa.Table:
    """Links of a cell that join components, confirmed on full sets."""
    sets = [shingle_set(t.as_py()) for t in table.column("body")]
    values, where = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
    ends = np.cumsum([len(s) for s in sets])
    node, component = np.asarray(table.column("node")), np.asarray(table.column("cn"))
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    held = np.zeros(len(values), bool)
    for x, ms in _candidates(table):
        ms = np.array([m for m in ms if find(int(component[m])) != find(int(component[x]))], np.int64)
        if not len(ms):
            continue
        own = where[ends[x] - len(sets[x]) : ends[x]]
        held[own] = True
        both = np.array([np.count_nonzero(held[where[ends[m] - len(sets[m]) : ends[m]]]) for m in ms])
        held[own] = False
        for m, k in zip(ms, both, strict=True):
            if 100 * k >= THRESHOLD_PERCENT * (len(own) + len(sets[m]) - k) and find(int(component[m])) != find(int(component[x])):
                root[find(int(component[m]))] = find(int(component[x]))
                a.append(int(node[x]))
                b.append(int(node[m]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cells(placed: DataFrame, weight: str) -> DataFrame:
    """Deal the buckets of ``placed`` (key, node, cn, out, ...) out to cells: small buckets share one, large ones are cut in blocks.

    Roles: 0 compared, 1 compared with, 2 both.
    """
    stats = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("out").cast("int")).alias("x"), F.sum(weight).alias("w"), F.sum(F.when(F.col("out"), F.col(weight)).otherwise(0)).alias("wx")).filter("m > 1 AND x > 0")
    stats = stats.select("key", "m", "w", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_BYTES)).cast("int").alias("nm"), F.ceil(F.greatest(F.col("x") / BLOCK, F.col("wx") / BLOCK_BYTES)).cast("int").alias("nx"))
    stats = settle(stats.withColumn("whole", (F.col("m") <= SMALL) & (F.col("nm") == 1)), "cells")
    # small buckets are dealt out by their rows and bytes, so that no cell holds much more than two blocks
    fill = F.greatest(F.sum(F.col("m") / (2 * BLOCK)), F.sum(F.col("w") / (2 * BLOCK_BYTES)))
    sizes = {r["whole"]: r for r in stats.groupBy("whole").agg(fill.alias("fill"), F.sum(F.col("nm") * F.col("nx")).alias("blocks")).collect()}
    bins = ceil(sizes[True]["fill"]) if True in sizes else 1
    cells = bins + (sizes[False]["blocks"] if False in sizes else 0)
    shuffled = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cell = lambda xb, mb, role: F.struct(xb.alias("xb"), mb.alias("mb"), F.lit(role).alias("role"))
    zero = F.lit(0)
    small = F.array(F.when(F.col("out"), cell(zero, zero, 2)).otherwise(cell(zero, zero, 1)))
    large = F.concat(F.transform(F.sequence(zero, F.col("nx") - 1), lambda i: cell(i, at("nm"), 1)), F.when(F.col("out"), F.transform(F.sequence(zero, F.col("nm") - 1), lambda i: cell(at("nx"), i, 0))).otherwise(F.array().cast("array<struct<xb:int,mb:int,role:int>>")))
    dealt = placed.join(stats.drop("m", "w"), "key").withColumn("c", F.explode(F.when(F.col("whole"), small).otherwise(large)))
    part = F.xxhash64("key", "c.xb", "c.mb")
    dealt = dealt.withColumn("cell", F.when(F.col("whole"), F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(part)).withColumns({"part": part, "role": F.col("c.role")}).drop("c", "nm", "nx", "whole")
    # comparing is long for the bytes it reads: a fixed number of tasks, which are not merged by size
    return dealt.repartition(max(min(cells, shuffled), cells // TASK_CELLS), "cell")


def _joining_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes of one bucket (key, node, cn, out) that are in different components."""
    signed = placed.join(nodes, "node").withColumn("bytes", F.lit(4 * HASHES))
    alive = _cells(signed, "bytes").select("cell", "part", "role", "key", "node", "cn", "n_shingles", "sig").groupBy("cell").applyInArrow(_alive, "key bigint, node bigint")
    alive = settle(alive.distinct(), "alive")
    bodies = _needed(alive.select(F.col("node").alias("doc_id")), texts).select(F.col("doc_id").alias("node"), "body", F.length("body").alias("bytes"))
    full = settle(placed.join(alive, ["key", "node"]).join(nodes, "node").join(bodies, "node"), "full")
    return settle(_cells(full, "bytes").select("cell", "part", "role", "key", "node", "cn", "n_shingles", "sig", "body").groupBy("cell").applyInArrow(_joining, "a bigint, b bigint").distinct(), "joining")


def _with_component(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept and the columns in ``carry``.

    A text without words has an empty set and links with nothing; so does a row with null doc_id, whose component is null and
    which is kept. Rows of one doc_id and text are one document; of one doc_id with several texts each row goes by its own text.
    Copies share a node, however many they are.
    """
    docs = narrow(docs, "doc_id", "text", carry=carry)
    along = docs.columns[2:]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"), *along)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in along)
    rows = settle(texts.mapInArrow(_nodes, "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, sig binary" + kinds), "sets")
    texts = texts.select("doc_id", "body")
    real = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(real.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = settle(real.join(classes.select(F.col("node").alias("doc_id"), F.col("hi").alias("hi_"), F.col("lo").alias("lo_")), "doc_id").filter("hi = hi_ AND lo = lo_").select(F.col("doc_id").alias("node"), "n_shingles", "sig"), "nodes")

    bands = nodes.select("node", "sig").mapInArrow(_bands, "key bigint, node bigint")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").drop("n")
    members = settle(bands.join(buckets, "key").filter("node > hub"), "buckets")
    tested = settle(_compare(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes), "tested")

    # the likeliest partner of each node first: most other pairs then lie within one component
    likeliest = settle(tested.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b"), "likeliest")
    links = _confirmed(likeliest, texts)
    labels = settle(components(links), "labels")
    rest = _with_component(_with_component(tested.select("a", "b"), "a", labels, "ca"), "b", labels, "cb").filter("ca <> cb").select("a", "b")
    rest = settle(rest.join(likeliest, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, texts))
        labels = settle(components(links), "labels")

    placed = _with_component(_with_component(members, "node", labels, "cn"), "hub", labels, "ch")
    placed = settle(placed.select("key", "node", "cn", (F.col("cn") != F.col("ch")).alias("out")), "placed")
    late = _joining_links(placed, nodes, texts)
    if not late.isEmpty():
        labels = settle(components(links.unionByName(late)), "labels")

    named = _with_component(classes, "node", labels, "component_id").select("hi", "lo", "n_shingles", "component_id")
    full = rows.withColumn("real", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    inside = full.filter("real").join(named, ["hi", "lo", "n_shingles"]).select("doc_id", "n_shingles", "component_id", *along)
    outside = full.filter("NOT real").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *along)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return inside.unionByName(outside).select("doc_id", "n_shingles", "component_id", kept, *carried(carry))

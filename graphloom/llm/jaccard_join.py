"""Exact Jaccard join of shingle sets in the metric space of d = 1 - J, by pivots, Voronoi regions and triangle windows.

Pivots of the first level are sets of one shingle: a document is nearest to those it holds, and of these its region's is the
rarest. Documents as first pivots would leave nearly every text at distance 1 from all of them, where no window is narrow. A
set within THETA of x has lost at most the share THETA of x's shingles, so its window over the regions is its first
floor(THETA * |x|) + 1 shingles, rarest first: two linked sets meet in a region of both windows.

In a region documents are the pivots; members without another of a size that a link allows leave it first. The smallest one measures its distance to all others, exactly wherever sizes and parity
bitmaps (whose Hamming distance never exceeds the symmetric difference) leave up to 2 * THETA; those within THETA are linked.
Only documents outside the pivot's component stay, with those that the triangle inequality lets them reach: another document
y may be linked with x only if |d(x, p) - d(y, p)| <= THETA. They are dealt to cells, where regions around further pivots, each
with the boundary documents within d(y, p) + 2 * THETA, are joined recursively and exactly on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.near_dedup import _buckets_of, _cells, _mix, _needed, _with_component
from graphloom.llm.shared import carried, drop_settled, narrow, settle

WORDS = 3
#: 100 times the Jaccard similarity of a link: 90 % and more.
PERCENT = 90
THETA = 1 - PERCENT / 100
#: Similarity, in 100, of two sets at 2 * THETA from each other.
NEAR = 2 * PERCENT - 100
#: Counters that tell frequent shingles from rare ones, and counters of a row in which they are handed on.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Shingles that a task gathers before it counts them.
GATHERED = 1 << 20
#: Bits of the parity bitmap of a set at least; a larger set has as many bits as shingles, rounded up to a power of two.
BITS = 1024
#: Members of a region that are compared without further pivots, pivots of a larger one.
LEAF, PIVOTS = 64, 8

_WEIGHTS = np.random.default_rng(20250211).integers(1, 2**63, WORDS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the three-word shingles of a text; the words of a shorter text make one."""
    words = (text or b"").lower().split()  # on bytes: only A-Z change, only [\x20\x09-\x0D] separate
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64) * _WEIGHTS[WORDS]
    for k in range(size):
        h += w[k : len(w) - size + 1 + k] * _WEIGHTS[k]
    return np.unique(_mix(h))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each bit."""
    bits = max(BITS, 1 << max(len(shingles) - 1, 0).bit_length())
    at = ((shingles >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of 64-bit words as that of the same set over fewer bits."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def apart_at_least(x: bytes, y: bytes) -> int:
    """What the symmetric difference of two sets is at least, by their bitmaps."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def window_of(size: int) -> int:
    """Shingles of a set of ``size`` of which a linked set holds at least one, whichever order both are taken in."""
    return size - -(-PERCENT * size // 100) + 1


def _may_reach(size_x, size_y, apart, percent: int):
    """Whether sets of these sizes whose symmetric difference is at least ``apart`` may have a similarity of ``percent`` or more."""
    return (100 * np.minimum(size_x, size_y) >= percent * np.maximum(size_x, size_y)) & ((100 + percent) * apart <= (100 - percent) * (size_x + size_y))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (doc_id, body, ...): size and 128-bit hash of its set; at the end the task's counts of shingles, in rows of CHUNK counters."""
    counts, waiting, held, schema = np.zeros(COUNTERS, np.int64), [], 0, None

    def count() -> None:
        nonlocal counts, waiting, held
        if waiting:
            counts += np.bincount((np.concatenate(waiting) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        waiting, held = [], 0

    for batch in batches:
        schema = batch.schema
        n, hi, lo = [], [], []
        for body in batch.column(1):
            s = shingle_set(body.as_py())
            n.append(len(s))
            hi.append(int(_mix(s ^ _WEIGHTS[WORDS + 1]).sum(dtype=np.uint64).astype(np.int64)))
            lo.append(int(_mix(s ^ _WEIGHTS[WORDS + 2]).sum(dtype=np.uint64).astype(np.int64)))
            waiting.append(s)
            held += len(s)
            if held >= GATHERED:
                count()
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), *batch.columns[2:]], ["doc_id", "n_shingles", "hi", "lo", "chunk", "counts", *schema.names[2:]])
    count()
    chunks = [c for c in range(COUNTERS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
    if chunks:
        some = [counts[c * CHUNK : (c + 1) * CHUNK].astype("<i4").tobytes() for c in chunks]
        empty = [pa.nulls(len(chunks), pa.int64()) for _ in range(4)]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(chunks, pa.int32()), pa.array(some, pa.binary()), *[pa.nulls(len(chunks), f.type) for f in list(schema)[2:]]], ["doc_id", "n_shingles", "hi", "lo", "chunk", "counts", *schema.names[2:]])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each chunk, from (chunk, counts) sorted by chunk."""
    chunk, total = None, np.zeros(CHUNK, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
    for batch in batches:
        for c, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if c != chunk:
                if chunk is not None:
                    yield row()
                chunk, total = c, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(counts.as_py(), "<i4")
    if chunk is not None:
        yield row()


def frequencies(rows: DataFrame) -> np.ndarray:
    """How often shingles of each counter occur: ``COUNTERS`` numbers, whatever the corpus."""
    counts = rows.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in counts.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    return out


def _windows(frequency):
    """(node, body) to rows of its window, (key, node, n_shingles); one more row, without key, has the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequency.value, "<i8")
        for batch in batches:
            keys, size, maps = [], [], []
            for body in batch.column(1):
                s = shingle_set(body.as_py())
                first = np.lexsort((s, often[(s % np.uint64(COUNTERS)).astype(np.int64)]))[: window_of(len(s))]
                keys.append(s[first].view(np.int64))
                size.append(len(s))
                maps.append(bitmap(s))
            if not keys:
                continue
            node = np.asarray(batch.column(0))
            held = [len(k) for k in keys]
            at = np.repeat(node, held)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(at), pa.array(np.repeat(np.array(size, np.int64), held)), pa.nulls(len(at), pa.binary())], ["key", "node", "n_shingles", "bits"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], ["key", "node", "n_shingles", "bits"])

    return run


def _maps(column) -> np.ndarray:
    """Bitmaps of a column, all folded to BITS bits."""
    return np.array([folded(np.frombuffer(x, np.uint64), BITS // 64) for x in column.to_pylist()], np.uint64).reshape(-1, BITS // 64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, bits_a, bits_b, n_a, n_b) that sizes and bitmaps let be within 2 * THETA."""
    for batch in batches:
        if batch.num_rows:
            apart = np.array([apart_at_least(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            ok = _may_reach(np.asarray(batch.column(4)), np.asarray(batch.column(5)), apart, NEAR)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(i))[ok]) for i in (0, 1)], ["a", "b"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, together) of the pairs of (a, b, body_a, body_b) that are within 2 * THETA: sizes of intersection and union."""
    last, held = None, None
    for batch in batches:
        out = []
        for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, held = a, shingle_set(s.as_py())
            other = shingle_set(t.as_py())
            both = len(np.intersect1d(held, other, assume_unique=True))
            if 100 * both >= NEAR * (len(held) + len(other) - both):
                out.append((a, b, both, len(held) + len(other) - both))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [], []))], ["a", "b", "shared", "together"])


def _in_windows(x: int, others: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Those of ``others`` that the distances to the region's pivot let be linked with ``x``; NaN: beyond 2 * THETA, -1: not known."""
    d, e = distance[x], distance[others]
    if d < 0:
        return others
    far, out = np.isnan(e), THETA - 1e-9
    near = e > out if np.isnan(d) else np.abs(d - e) <= THETA + 1e-9
    # what is beyond 2 * THETA cannot be linked with what is within THETA
    return others[near | (e < 0) | far & (np.isnan(d) or d > out)]


def _reachable(table: pa.Table) -> pa.Table:
    """The rows of a cell that may have a link across components, by sizes, bitmaps and distances to the pivot."""
    found = np.zeros(table.num_rows, bool)
    if table.num_rows:
        whole = table.column("bits").to_pylist()
        maps, size, component, distance = _maps(table.column("bits")), np.asarray(table.column("n_shingles")), np.asarray(table.column("cn")), table.column("distance").to_numpy(zero_copy_only=False).astype(float)
        for _, xs, ms in _buckets_of(table):
            for x in xs:
                m = _in_windows(x, ms[component[ms] != component[x]], distance)
                m = m[_may_reach(size[m], size[x], _apart(maps[m], maps[x]), PERCENT)]
                if size[x] > BITS:
                    m = np.array([y for y in m if _may_reach(size[y], size[x], apart_at_least(whole[x], whole[y]), PERCENT)], np.int64)
                if len(m):
                    found[x] = found[m] = True
    return pa.table({c: pa.array(np.asarray(table.column(c))[found]) for c in ("key", "node")})


class _Region:
    """Sets of one cell with their components; ``join`` finds links across components."""

    def __init__(self, sets: list[np.ndarray], node: np.ndarray, component: np.ndarray) -> None:
        values, where = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0, np.int64))
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [where[e - len(s) : e] for s, e in zip(sets, ends, strict=True)]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.held = np.zeros(len(values), bool)
        self.node, self.component = node, component
        self.root = {int(c): int(c) for c in component}
        self.links: list[tuple[int, int]] = []

    def find(self, row: int) -> int:
        c = int(self.component[row])
        while self.root[c] != c:
            self.root[c] = self.root[self.root[c]]
            c = self.root[c]
        return c

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        self.held[self.sets[x]] = True
        out = np.array([np.count_nonzero(self.held[self.sets[m]]) for m in others], np.int64)
        self.held[self.sets[x]] = False
        return out

    def link(self, x: int, others: np.ndarray) -> np.ndarray:
        """Note the links of ``x`` with ``others`` that join components; the distances."""
        both = self.shared(x, others)
        union = self.size[x] + self.size[others] - both
        for m, ok in zip(others, 100 * both >= PERCENT * union, strict=True):
            if ok and self.find(m) != self.find(x):
                self.root[self.find(m)] = self.find(x)
                self.links.append((int(self.node[x]), int(self.node[m])))
        return 1 - both / np.maximum(union, 1)

    def join(self, xs: np.ndarray, ms: np.ndarray) -> None:
        """Links of rows ``xs`` with rows ``ms``: by regions around pivots, as long as those are smaller than the whole."""
        if len(xs) * len(ms) > LEAF * LEAF:
            rows = np.union1d(xs, ms)
            pivots = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
            apart = np.array([self.link(p, rows) for p in pivots])
            nearest = apart.argmin(axis=0)
            window = apart <= apart.min(axis=0) + 2 * THETA + 1e-9
            at = np.searchsorted(rows, xs), np.searchsorted(rows, ms)
            # a pair is met in the region of x: y lies in it or within its boundary
            regions = [(xs[nearest[at[0]] == k], ms[window[k][at[1]]]) for k in range(PIVOTS)]
            if sum(len(x) * len(m) for x, m in regions) < 0.7 * len(xs) * len(ms):
                for x, m in regions:
                    self.join(x, m)
                return
        for x in xs:
            m = ms[100 * np.minimum(self.size[ms], self.size[x]) >= PERCENT * np.maximum(self.size[ms], self.size[x])]
            m = np.array([y for y in m if self.find(y) != self.find(x)], np.int64)
            if len(m):
                self.link(x, m)


def _joined(table: pa.Table) -> pa.Table:
    """Links of a cell that join components, on full sets."""
    region = _Region([shingle_set(t.as_py()) for t in table.column("body")], np.asarray(table.column("node")), np.asarray(table.column("cn")))
    if table.num_rows:
        for _, xs, ms in _buckets_of(table):
            region.join(xs, ms)
    a, b = zip(*region.links, strict=True) if region.links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _regions(classes: DataFrame, texts: DataFrame, frequency: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Regions of more than one node, (key, node, pivot), and the nodes (node, n_shingles, bits)."""
    shipped = classes.sparkSession.sparkContext.broadcast(frequency.astype("<i8").tobytes())
    bodies = _needed(classes.select(F.col("node").alias("doc_id")), texts)
    windows = settle(bodies.mapInArrow(_windows(shipped), "key bigint, node bigint, n_shingles bigint, bits binary"), "windows")
    # one shuffle by key: a member stays if the size next to its own, up or down, is that of a set it may be linked with
    keys = windows.filter("key IS NOT NULL").select("key", "node", "n_shingles").repartition("key")
    by_size, size = W.partitionBy("key").orderBy("n_shingles"), F.col("n_shingles")
    fits = F.coalesce(F.lag(size).over(by_size) * 100 >= size * PERCENT, F.lit(False)) | F.coalesce(F.lead(size).over(by_size) * PERCENT <= size * 100, F.lit(False))
    within = W.partitionBy("key")
    shared = keys.withColumn("fits", fits).filter("fits").withColumns({"pivot": F.min("node").over(within), "last": F.max("node").over(within)})
    regions = settle(shared.filter("pivot < last").select("key", "node", "pivot").distinct(), "regions")
    nodes = settle(windows.filter("key IS NULL").drop("key").distinct(), "nodes")
    drop_settled(windows)
    return regions, nodes


def _distances(regions: DataFrame, measured: DataFrame, classes: DataFrame) -> DataFrame:
    """``regions`` with the distance to the pivot: null beyond 2 * THETA, -1 where an id of several texts leaves none."""
    distance = measured.groupBy(F.col("a").alias("pivot"), F.col("b").alias("node")).agg(F.min(1 - F.col("shared") / F.col("together")).alias("distance"))
    out = regions.join(distance, ["pivot", "node"], "left").withColumn("distance", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
    several = settle(classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node"), "several")
    if several.isEmpty():
        return out
    for column in ("node", "pivot"):
        out = out.join(several.select(F.col("node").alias(column), F.lit(True).alias("several")), column, "left").withColumn("distance", F.when(F.col("several"), F.lit(-1.0)).otherwise(F.col("distance"))).drop("several")
    return out


def _late_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes of one region (key, pivot, node, cn, out, distance) that are in different components."""
    signed = placed.join(nodes, "node").withColumn("bytes", F.length("bits"))
    reached = _cells(signed, "bytes").select("cell", "part", "role", "key", "node", "cn", "n_shingles", "bits", "distance").groupBy("cell").applyInArrow(_reachable, "key bigint, node bigint")
    reached = settle(reached.distinct(), "reached")
    bodies = _needed(reached.select(F.col("node").alias("doc_id")), texts).distinct().select(F.col("doc_id").alias("node"), "body", F.length("body").alias("bytes"))
    # texts go once to each pivot, not to each shingle that leads to it
    full = placed.join(reached, ["key", "node"]).select(F.col("pivot").alias("key"), "node", "cn", "out").distinct()
    full = settle(full.join(bodies, "node"), "full")
    return settle(_cells(full, "bytes").select("cell", "part", "role", "key", "node", "cn", "body").groupBy("cell").applyInArrow(_joined, "a bigint, b bigint").distinct(), "joining")


def jaccard_components(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and the columns in ``carry``.

    A text without words has an empty set and links with nothing; so does a row with null doc_id, whose component is null. Rows
    of one doc_id and text are one document; one doc_id with several texts is linked by each of them. Equal sets are one node.
    """
    docs = narrow(docs, "doc_id", "text", carry=carry)
    along = docs.columns[2:]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"), *along)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in along)
    both = settle(texts.mapInArrow(_sets, "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, chunk int, counts binary" + kinds), "sets")
    rows = both.filter("chunk IS NULL").drop("chunk", "counts")
    real = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(real.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")

    texts = texts.select("doc_id", "body")
    regions, nodes = _regions(classes, texts, frequencies(both))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    pairs = regions.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    near = settle(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(_near, "a bigint, b bigint"), "near")
    needed = settle(_needed(near.select(F.explode(F.array("a", "b")).alias("doc_id")), texts).distinct(), "texts")
    full = lambda x: needed.select(F.col("doc_id").alias(x), F.col("body").alias(f"body_{x}"))
    measured = settle(near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "body_a", "body_b").mapInArrow(_measured, "a bigint, b bigint, shared bigint, together bigint"), "measured")
    drop_settled(needed)
    links = measured.filter(F.col("shared") * 100 >= F.col("together") * PERCENT).select("a", "b")
    labels = settle(components(links), "labels")

    placed = _with_component(_with_component(_distances(regions, measured, classes), "node", labels, "cn"), "pivot", labels, "cp").withColumn("out", F.col("cn") != F.col("cp"))
    # the window of a region: what is as far from the pivot as the nearest document outside its component, less THETA
    outer = placed.filter("out").groupBy("key").agg(F.min(F.coalesce("distance", F.lit(2 * THETA))).alias("nearest"))
    placed = placed.join(outer, "key").filter(F.col("out") | F.col("distance").isNull() | (F.col("distance") >= F.col("nearest") - THETA - 1e-9)).select("key", "pivot", "node", "cn", "out", "distance")
    placed = settle(placed, "placed")
    late = _late_links(placed, nodes, texts)
    if not late.isEmpty():
        labels = settle(components(links.unionByName(late)), "labels")

    named = _with_component(classes, "node", labels, "component_id").select("hi", "lo", "n_shingles", "component_id")
    full_rows = rows.withColumn("real", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    inside = full_rows.filter("real").join(named, ["hi", "lo", "n_shingles"]).select("doc_id", "n_shingles", "component_id", *along)
    outside = full_rows.filter("NOT real").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *along)
    return inside.unionByName(outside).select("doc_id", "n_shingles", "component_id", *carried(carry))


OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

|q - x|^2 orders as the inner product <q, x> - |x|^2 / 2, so the search is one for maximum inner product. Vectors are coded in
four bits for each pair of dimensions; residuals parallel to the vector, which move the score of the queries that matter, are
penalised more than orthogonal ones, in the codebooks as in the choice of codes. Tasks scan the codes with a table for each
query, two codes to a look-up, and hand on the best; those are ranked by their exact distance.

That ranking only bounds the distance of the k-th neighbour. A second scan goes on to every vector that the length of its
residual does not prove to be farther, however many share a code or nearly so, and ranks them exactly: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import narrow, settle

K = 10
#: Vectors that the codebooks are fitted on at most.
FIT_ROWS = 8192
#: Candidates of a query whose exact distance is computed to bound that of its k-th neighbour.
RERANK = 300
CENTRES = 16
#: Share of a vector's norm that a query must score to matter; sets the weight of parallel residuals.
MATTERS = 0.2
FIT_STEPS = 6
#: Queries that are handed to all tasks at a time at most, and bytes of their tables of scores.
QUERY_BLOCK, TABLE_BYTES = 4096, 64 << 20
#: Vectors and queries that the second scan compares at a time, and the pairs it holds before it keeps the nearest.
SCAN_ROWS, SCAN_QUERIES, HELD_PAIRS = 2048, 512, 200_000


def parallel_weight(dims: int) -> float:
    return max(1.0, (dims - 1) * MATTERS**2 / (1 - MATTERS**2))


def _split(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, 2), padded by zeros to an even number of subspaces."""
    pad = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, 2)


def assign(x: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of the rows of ``x``: from the nearest centres, coordinate descent on the weighted loss, subspace by subspace."""
    parts = _split(x)
    norm = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)
    unit = parts / norm[:, None, None]
    far = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3)  # rows, subspaces, centres
    along = np.einsum("nsd,skd->nsk", unit, books)
    own = (unit * parts).sum(axis=2)  # of the vector along itself, subspace by subspace
    codes = far.argmin(axis=2)
    rows = np.arange(len(x))
    residual = (own - np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]).sum(axis=1)
    for _ in range(sweeps):
        for s in range(parts.shape[1]):
            rest = residual - own[:, s] + along[rows, s, codes[:, s]]
            new = residual_loss(far[:, s], rest[:, None] + own[:, s : s + 1] - along[:, s], weight).argmin(axis=1)
            residual = rest + own[:, s] - along[rows, s, new]
            codes[:, s] = new
    return codes


def residual_loss(far: np.ndarray, along: np.ndarray, weight: float) -> np.ndarray:
    """|r|^2 + (weight - 1) * parallel(r)^2; what other subspaces add to |r|^2 is the same for every choice."""
    return far + (weight - 1) * along**2


def fit_books(x: np.ndarray, weight: float, steps: int = FIT_STEPS, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces, CENTRES, 2) that minimise the weighted loss over ``x`` by turns of coding and least squares."""
    rng = np.random.default_rng(seed)
    parts = _split(x)
    n, s, _ = parts.shape
    books = parts[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2).copy()
    for _ in range(8):  # plain k-means first
        codes = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3).argmin(axis=2)
        for k in range(CENTRES):
            hit = (codes == k)[:, :, None]
            count = hit.sum(axis=0)
            books[:, k] = np.where(count > 0, (parts * hit).sum(axis=0) / np.maximum(count, 1), books[:, k])
    unit = parts / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None, None]
    size = s * CENTRES * 2
    for _ in range(steps):
        codes = assign(x, books, weight)
        column = ((np.arange(s) * CENTRES)[None, :] + codes) * 2
        v = np.zeros((n, size), np.float32)
        right, count = np.zeros(size), np.zeros(size)
        for d in range(2):
            np.put_along_axis(v, column + d, unit[:, :, d].astype(np.float32), 1)
            right += np.bincount((column + d).ravel(), (weight * parts[:, :, d]).ravel(), size)
            count += np.bincount((column + d).ravel(), minlength=size)
        normal = (weight - 1) * (v.T @ v).astype(np.float64) + np.diag(count + 1e-6)
        solved = np.linalg.solve(normal, right + 1e-6 * books.ravel())
        books = np.where(count > 0, solved, books.ravel()).reshape(s, CENTRES, 2)
    return books


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    arrays = batch.column(column)
    return np.asarray(arrays.flatten(), np.float64).reshape(batch.num_rows, -1)


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, books, weight = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _vectors(batch, 1) - mean
                codes = assign(x, books, weight).astype(np.uint8)
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                residual = np.sqrt(((x - decoded(packed, books)[:, : x.shape[1]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array((x * x).sum(axis=1) / 2), pa.array(residual)], ["vec_id", "v", "code", "half", "residual"])

    return run


def decoded(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The centres that packed codes stand for, one row each, with the padded dimensions."""
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
    return books[np.arange(codes.shape[1])[None], codes].reshape(len(packed), -1)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores; of equal ones those with the smaller ids."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def _scan(queries, model, most: int):
    """For each query of the block, the best of a task, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, books, _ = model.value
        query_ids, vectors, _ = queries.value
        tables = np.einsum("qsd,skd->qsk", _split(vectors - mean), books).astype(np.float32)
        pairs = (tables[:, 0::2, None, :] + tables[:, 1::2, :, None]).reshape(len(tables), -1, 256)  # low code last, as packed
        held = [(np.empty(0, np.float32), np.empty(0, np.int64))] * len(query_ids)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            codes = np.ascontiguousarray(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1).T)
            half = np.asarray(batch.column(2)).astype(np.float32)
            for q in range(len(query_ids)):
                score = -half
                for table, code in zip(pairs[q], codes, strict=True):
                    score += table.take(code)
                at = best(score, ids, most + 1)
                at = at[ids[at] != query_ids[q]]
                score, own = np.concatenate([held[q][0], score[at]]), np.concatenate([held[q][1], ids[at]])
                at = best(score, own, most)
                held[q] = score[at], own[at]
        full = [q for q in range(len(query_ids)) if len(held[q][0])]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[full], pa.int64()), pa.array([held[q][0] for q in full], pa.list_(pa.float32())), pa.array([held[q][1] for q in full], pa.list_(pa.int64()))], ["query_id", "scores", "ids"])

    return run


def _merged(most: int):
    def run(table: pa.Table) -> pa.Table:
        scores, ids = (np.asarray(table.column(c).combine_chunks().flatten()) for c in ("scores", "ids"))
        own = ids[best(scores, ids, most)]
        return pa.table({"query_id": pa.array(np.full(len(own), table.column("query_id")[0].as_py()), pa.int64()), "vec_id": pa.array(own, pa.int64())})

    return run


def nearest_pairs(pairs: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """(place of the query, distance, id) of the nearest ``most`` of each query; of equal ones those with the smaller ids."""
    q, far, ids = (np.concatenate(c) for c in zip(*pairs, strict=True))
    order = np.lexsort((ids, far, q))
    q, far, ids = q[order], far[order], ids[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < most
    return q[keep], far[keep], ids[keep]


def first_copies(v: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, of equal vectors only the ``most`` with the smallest ids: the others are behind those for any query."""
    _, group = np.unique(v + 0.0, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    group = group.ravel()[order]
    return order[np.arange(len(order)) - np.searchsorted(group, group) < most]


def _rest(queries, model, k: int):
    """The nearest ``k`` of a task for each query of the block, out of all vectors that may be within the query's ``reach``.

    With centre c and residual r of a vector x, |q - x| >= |q - c| - |r| and <q, x> <= <q, c> + |q||r|; what passes both is
    compared exactly, first by matrix product up to its rounding, then term by term in the order of the final distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, books, _ = model.value
        query_ids, vectors, reach = queries.value
        reach = reach.copy()
        shifted = vectors - mean
        squares = (shifted * shifted).sum(axis=1)
        rounding = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
        held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(at, SCAN_ROWS)
                v, ids = _vectors(batch, 1), np.asarray(batch.column(0))
                chosen = first_copies(v, ids, k + 1)  # one of them may be the query itself
                v, ids, residual = v[chosen], ids[chosen], np.asarray(batch.column(3))[chosen, None]
                x = v - mean
                packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[chosen]
                centre = decoded(packed, books)[:, : x.shape[1]]
                own, middle = (x * x).sum(axis=1)[:, None], (centre * centre).sum(axis=1)[:, None]
                for first in range(0, len(query_ids), SCAN_QUERIES):
                    part = slice(first, first + SCAN_QUERIES)
                    q, qq, near = shifted[part], squares[None, part], reach[None, part]
                    slack = rounding * (own + middle + qq)
                    product = 2 * (centre @ q.T)
                    out = middle + qq - product > (near + residual) ** 2 + slack
                    out |= own + qq - product - 2 * np.sqrt(qq) * residual > near**2 + slack
                    rows, columns = np.flatnonzero(~out.all(axis=1)), np.flatnonzero(~out.all(axis=0))
                    if not len(rows):
                        continue
                    cell = np.ix_(rows, columns)
                    apart = own[rows] + qq[:, columns] - 2 * (x[rows] @ q[columns].T)
                    i, j = np.nonzero(~out[cell] & ~(apart > near[:, columns] ** 2 + slack[cell]))
                    i, j = rows[i], columns[j] + first
                    other = ids[i] != query_ids[j]
                    i, j = i[other], j[other]
                    for some in range(0, len(i), HELD_PAIRS):
                        a, b = i[some : some + HELD_PAIRS], j[some : some + HELD_PAIRS]
                        far = np.zeros(len(a))
                        for d in range(v.shape[1]):
                            far += (v[a, d] - vectors[b, d]) ** 2
                        far = np.sqrt(far)
                        inside = ~(far > reach[b])
                        held.append((b[inside], far[inside], ids[a][inside]))
                        if sum(len(h[0]) for h in held[1:]) > HELD_PAIRS:
                            held = [nearest_pairs(held, k)]
                            places, counts = np.unique(held[0][0], return_counts=True)
                            full = places[counts == k]
                            reach[full] = np.minimum(reach[full], held[0][1][np.searchsorted(held[0][0], full, "right") - 1])
        places, far, ids = nearest_pairs(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[places], pa.int64()), pa.array(ids, pa.int64()), pa.array(far)], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, finite, not zero; ids not null. A repeated id has its smallest vector."""
    v = F.col(column).cast("array<double>")
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    some = some.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return some.groupBy("vec_id").agg(F.min("v").alias("v"))


def query_block(dims: int) -> int:
    """Queries of a block: a query's table has 256 scores of four bytes for every four dimensions."""
    return max(64, min(QUERY_BLOCK, TABLE_BYTES // (1024 * -(-dims // 4))))


def nearest_neighbours(vectors: DataFrame, column: str = "embedding", k: int = K, every: int = 100, rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest by Euclidean distance for each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Every row is indexed; the codebooks come from ``FIT_ROWS`` rows at most. The neighbours are exact, whatever ``rerank`` is.
    Copies of a vector tie and go by id. A repeated id is one vector (its copies are never its own neighbours). Vectors of different
    lengths have no distance: those of each length are searched among themselves.
    """
    rows = settle(usable(narrow(vectors, "vec_id", column), column), "vectors")
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, [_nearest(rows.filter(F.size("v") == d), d, k, every, rerank) for d in lengths])


def _nearest(rows: DataFrame, dims: int, k: int, every: int, rerank: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) <= int(1_000_000 * min(1, FIT_ROWS / n))).select("v").limit(FIT_ROWS).collect()
    fit = np.unique(np.array([r["v"] for r in sample or rows.select("v").limit(1).collect()]), axis=0)  # copies count once
    mean = fit.mean(axis=0)
    weight = parallel_weight(fit.shape[1])
    model = spark.sparkContext.broadcast((mean, fit_books(fit - mean, weight), weight))
    codes = settle(rows.mapInArrow(_encode(model), "vec_id bigint, v array<double>, code binary, half double, residual double"), "codes")
    rows = codes.select("vec_id", "v")

    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // query_block(dims)))

    def block(table: DataFrame, b: int) -> tuple:
        part = table.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).orderBy("vec_id").collect()
        return np.array([r["vec_id"] for r in part], np.int64), np.array([r["v"] for r in part]).reshape(len(part), fit.shape[1]), part

    def pass_over(table: DataFrame, scan, merge=None) -> DataFrame:
        """One scan for each block of queries, each written before the next begins: neither plan nor driver grows with the queries."""
        found = []
        for b in range(blocks):
            ids, own, part = block(table, b)
            reach = np.array([np.inf if "reach" not in r or r["reach"] is None else r["reach"] for r in part])
            queries = spark.sparkContext.broadcast((ids, own, reach))
            near = scan(queries)
            found.append(settle(merge(near) if merge else near, "near"))
            queries.destroy()
        return reduce(DataFrame.unionByName, found)

    found = pass_over(asked, lambda queries: codes.select("vec_id", "code", "half").mapInArrow(_scan(queries, model, rerank), "query_id bigint, scores array<float>, ids array<bigint>"), lambda near: near.groupBy("query_id").applyInArrow(_merged(rerank), "query_id bigint, vec_id bigint"))
    exact = found.join(rows, "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    distance = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = exact.select("query_id", "vec_id", distance.alias("score")).withColumn("rank", F.row_number().over(order))
    kth = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    asked = settle(asked.join(kth, "vec_id", "left"), "asked")

    found = pass_over(asked, lambda queries: codes.select("vec_id", "v", "code", "residual").mapInArrow(_rest(queries, model, k), "query_id bigint, vec_id bigint, score double"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

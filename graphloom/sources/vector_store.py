"""Points in cells on disk, for the nearest by cosine: a search reads only cells that may hold one.

Vectors are brought to length one, where cosine orders as Euclidean distance. Cells are those of centres fitted on a bounded sample,
each with the largest distance of its points from the centre. A search first reads the nearest cells of each query; the distance d of
the k-th point then found proves by the triangle inequality that no cell holds a nearer one whose centre is farther than d plus its
radius. The other cells are read too, so that the result is exact. Points are replaced by id, in batches that are merged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import with_checkpoints
from graphloom.sources.graph_store import MergedTables

#: Points that the centres are fitted on at most, and rounds of that.
FIT_ROWS, ROUNDS = 8192, 12
#: Cells of a query that are read first; queries that are handed to the tasks at a time.
PROBED, QUERY_BLOCK = 2, 1024
#: More than the rounding of distances of vectors of length one.
SLACK = 1e-9


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = np.asarray(batch.column(column).flatten(), np.float64).reshape(batch.num_rows, -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0))


def fit_centres(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of at most so many cells, by k-means; empty ones are left where they are."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = _apart(x, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class VectorStore(MergedTables):
    """Points (id, vector) of one number of dimensions."""

    tables = ("points",)
    part = "cell"

    def __init__(self, spark: SparkSession, path: str, cells: int = 64) -> None:
        super().__init__(spark, path)
        self.cells = cells

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # a row a cell
        return np.array([r["centre"] for r in rows])

    def _placed(self, points: DataFrame) -> DataFrame:
        """(id, vector, cell, apart): vectors of length one, their nearest centre and its distance."""
        centres = self.spark.sparkContext.broadcast(self._centres())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(batch, 1)
                    far = _apart(x, centres.value)
                    cell = far.argmin(axis=1)
                    exact = np.sqrt(((x - centres.value[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(exact)], ["id", "vector", "cell", "apart"])

        return points.select("id", "vector").mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, vector array<double>, cell int, apart double")

    @staticmethod
    def usable(points: DataFrame) -> DataFrame:
        """Points with an id and a vector of finite numbers that are not all zero."""
        v = F.col("vector").cast("array<double>")
        some = points.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", v.alias("vector"))
        return some.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))

    def upsert(self, points: DataFrame, batch: int) -> bool:
        """Put points in, in place of those with their ids; of several with one id the largest vector. False if the batch was merged before."""
        with_checkpoints(self.spark)
        self.recover()
        if self._state(batch) == "committed":
            return False
        new = self.usable(points).groupBy("id").agg(F.max("vector").alias("vector")).checkpoint()
        if not self._exists(f"{self.path}/centres"):
            n = max(1, new.count())
            some = new.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, FIT_ROWS / n))).select("vector").limit(FIT_ROWS).collect()
            x = np.array([r["vector"] for r in some or new.select("vector").limit(1).collect()], float)
            if not len(x):
                return False
            centres = fit_centres(x / np.sqrt((x * x).sum(axis=1))[:, None], self.cells)
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        placed = self._placed(new).checkpoint()
        whole = placed
        touched = {r["cell"] for r in placed.select("cell").distinct().collect()}  # numbers of cells
        if self._parts(f"{self.path}/points"):
            old = self.spark.read.parquet(f"{self.path}/points")
            touched |= {r["cell"] for r in old.select("id", "cell").join(new.select("id"), "id", "left_semi").select("cell").distinct().collect()}
            whole = old.filter(F.col("cell").isin(sorted(touched))).join(new.select("id"), "id", "left_anti").select("id", "vector", "cell", "apart").unionByName(placed)
        self._set_aside(batch, "points", whole)
        self.spark.createDataFrame([(c,) for c in sorted(touched)], "cell int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/aside/{batch}/touched")
        self._mark(batch, "prepared")
        self._overwrite(batch)
        return True

    def _finish(self, batch: int) -> None:
        """Cells that all points have left go."""
        left = self._parts(f"{self.path}/aside/{batch}/points")
        for r in self.spark.read.parquet(f"{self.path}/aside/{batch}/touched").collect():
            if f"cell={r['cell']}" not in left:
                fs, target = self._file(f"{self.path}/points/cell={r['cell']}")
                fs.delete(target, True)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The ``k`` points nearest to each query (query_id, vector) by cosine: query_id, id, score, rank; ties to the smaller id."""
        with_checkpoints(self.spark)
        points = self.spark.read.parquet(f"{self.path}/points")
        centres = self._centres()
        radius = np.full(len(centres), -np.inf)
        for r in points.groupBy("cell").agg(F.max("apart").alias("r")).collect():  # a row a cell
            radius[r["cell"]] = r["r"]
        asked = self.usable(queries.withColumnRenamed("query_id", "id")).checkpoint()
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        out = None
        for b in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
            if not part:
                continue
            ids = [r["id"] for r in part]
            q = np.array([r["vector"] for r in part])
            q /= np.sqrt((q * q).sum(axis=1))[:, None]
            far = _apart(q, centres)
            far[:, radius < 0] = np.inf
            rank = far.argsort(axis=1, kind="stable").argsort(axis=1)
            first = (rank < PROBED) & np.isfinite(far)
            found = self._scan(points, ids, q, first, k).checkpoint()
            kth = {r["query_id"]: r["d"] for r in found.filter(F.col("rank") == k).select("query_id", "d").collect()}
            reach = np.array([kth.get(i, np.inf) for i in ids])
            rest = ~first & np.isfinite(far) & (far - np.maximum(radius, 0)[None] <= reach[:, None] + SLACK)
            if rest.any():
                found = self._best(found.drop("rank").unionByName(self._scan(points, ids, q, rest, k).drop("rank")), k).checkpoint()
            out = found if out is None else out.unionByName(found)
        if out is None:
            return asked.select(F.col("id").alias("query_id"), F.col("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        return out.select("query_id", "id", (1 - F.col("d") * F.col("d") / 2).alias("score"), "rank")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d", "id"))).filter(F.col("rank") <= k)

    def _scan(self, points: DataFrame, ids: list, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The best of the wanted cells (a row a query, a column a cell): only their folders are read."""
        cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
        shipped = self.spark.sparkContext.broadcast((q, wanted))
        kind = points.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, wanted = shipped.value
            held: dict[int, tuple[np.ndarray, list]] = {}
            types = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                types = batch.schema.field(0).type
                own, cell = batch.column(0).to_pylist(), np.asarray(batch.column(2))
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
                for i in np.flatnonzero(wanted[:, np.unique(cell)].any(axis=1)):
                    at = np.flatnonzero(wanted[i, cell])
                    d = np.concatenate([held[i][0], np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))]) if i in held else np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    names = (held[i][1] if i in held else []) + [own[j] for j in at]
                    order = sorted(range(len(names)), key=lambda j: (d[j], names[j]))[:k]
                    held[i] = d[order], [names[j] for j in order]
            rows = [(int(i), n, float(v)) for i, (d, names) in held.items() for v, n in zip(d, names, strict=True)]
            if rows:
                no, names, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(names, types), pa.array(d)], ["no", "id", "d"])

        near = points.filter(F.col("cell").isin(cells)).select("id", "vector", "cell").mapInArrow(run, f"no int, id {kind}, d double")
        numbers = self.spark.createDataFrame(list(enumerate(ids)), f"no int, query_id {kind}")
        return self._best(near.join(F.broadcast(numbers), "no").select("query_id", "id", "d"), k)

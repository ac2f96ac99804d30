"""Exact vector search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def top_k(points: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, block: int = 4096) -> DataFrame:
    """The ``k`` points (id, vector) of the highest cosine with each query (query_id, query); ``where`` filters points before the search.

    Queries are handed to every task ``block`` at a time, told by hash; each block is one pass over the points.
    """
    some = points if where is None else points.filter(where)
    blocks = max(1, -(-queries.count() // block))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def nearest(part: DataFrame) -> DataFrame:
        scored = some.crossJoin(F.broadcast(part)).select("query_id", "id", F.round(cosine(F.col("vector"), F.col("query")), 6).alias("score"))
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [nearest(queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)) for b in range(blocks)])


def hashed_words(text: Column, dims: int = 384) -> Column:
    """A deterministic encoder without a model: normalised counts of words, dealt to dimensions by hash."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    # sorted cells, then a look-up of the first and last place of each: one pass over the words
    ordered = F.array_sort(F.concat(cells, F.sequence(F.lit(0), F.lit(dims - 1))))
    marks = F.filter(F.transform(ordered, lambda c, i: F.when((i == 0) | (F.get(ordered, i - 1) != c), i)), lambda x: x.isNotNull())
    ends = F.concat(F.slice(marks, 2, dims), F.array(F.size(ordered)))
    counts = F.zip_with(marks, ends, lambda a, b: (b - a - 1).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

"""A posting index of trigrams over texts of several sources: a term is looked up, not searched for in every row.

The index is two folders of Parquet files: postings (bucket, gram, text), sorted by gram and text within buckets of its hash, and how many
texts hold each gram. A text is indexed once, however many facts hold it. A look-up reads the buckets of the rarest trigrams of each term,
takes the texts that hold them all for candidates, and confirms those. Facts stay where they are: they are met by a hash of their texts
and confirmed again, without a shuffle up to ``BROADCAST`` texts found.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM = 3
#: Trigrams of a term that are looked up, the rarest ones; candidates are confirmed anyway.
LOOKED_UP = 4
#: Facts that a look-up gives of each term and source, facts in all, and terms, by default.
PER_SOURCE, IN_ALL, TERMS = 10, 20, 8
#: Texts found, a number each, that go to every task; with more, facts are shuffled by the hashes of their texts.
BROADCAST = 4_000_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none if it is shorter."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def _grams_of(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


class TextIndex:
    """An index under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, facts: DataFrame) -> TextIndex:
        """Index facts (source, id, texts), ``texts`` an array of what may be searched. A trigram of very many texts lies in many files."""
        texts = facts.select(F.explode("texts").alias("text")).filter("text IS NOT NULL").distinct()
        postings = texts.select("text", F.explode(grams(F.col("text"))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        # dealt out by range of gram and text, so that one gram may fill several tasks
        postings.repartitionByRange("bucket", "gram", "text").sortWithinPartitions("bucket", "gram", "text").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")
        stored = self.spark.read.parquet(f"{self.path}/postings")
        stored.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _of(self, table: str, wanted: list[str]) -> DataFrame:
        """Rows of some grams: only their buckets are read."""
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        keys = self.spark.createDataFrame([(g,) for g in wanted], "gram string")
        buckets = sorted({r["b"] for r in keys.select(self._bucket(F.col("gram")).alias("b")).collect()})
        return rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).drop("bucket")

    def candidates(self, terms: list[str]) -> DataFrame:
        """(term, text) of texts that hold the rarest trigrams of a term; a superset of those that hold it."""
        of_term = {t: _grams_of(t) for t in terms if len(t) >= GRAM}
        every = sorted({g for grams_ in of_term.values() for g in grams_})
        counted = {r["gram"]: r["n"] for r in self._of("counts", every).collect()} if every else {}  # grams of the terms
        rarest = {t: sorted(g, key=lambda x: (counted.get(x, 0), x))[:LOOKED_UP] for t, g in of_term.items()}
        asked = [(t, g, len(gs)) for t, gs in rarest.items() if all(x in counted for x in gs) for g in gs]
        rows = self.spark.createDataFrame(asked, "term string, gram string, of int")
        found = self._of("postings", sorted({g for _, g, _ in asked})) if asked else self.spark.createDataFrame([], "gram string, text string")
        hits = found.join(F.broadcast(rows), "gram").groupBy("term", "text").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of"))
        return hits.filter("n = of").select("term", "text")

    def search(self, facts: DataFrame, terms: list[str]) -> DataFrame:
        """Facts that hold a term in any of their texts, in any case: (term_no, term) and the columns of ``facts``.

        Terms of one or two characters have no trigram: for those alone the facts are read through.
        """
        low = [t.lower() for t in terms]
        numbers = self.spark.createDataFrame([(i, t) for i, t in enumerate(low)], "term_no int, term string")
        holds = F.exists("texts", lambda t: F.coalesce(F.contains(F.lower(t), F.col("term")), F.lit(False)))
        confirmed = self.candidates(list(dict.fromkeys(low))).filter(F.contains(F.lower("text"), F.col("term")))
        path = f"{self.path}/found-{uuid.uuid4().hex}"
        confirmed.select("term", F.xxhash64("text").alias("key")).distinct().write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema("term string, key long").parquet(path)
        few = found.count() <= BROADCAST
        keys = found.join(F.broadcast(numbers), "term")
        each = facts.select("*", F.posexplode("texts").alias("at", "__text")).withColumn("key", F.xxhash64("__text"))
        earlier = F.exists(F.slice("texts", F.lit(1), F.col("at")), lambda t: F.coalesce(F.contains(F.lower(t), F.col("term")), F.lit(False)))
        told = each.join(F.broadcast(keys) if few else keys, "key").filter(F.contains(F.lower("__text"), F.col("term")) & ~earlier)
        parts = [told.select("term_no", "term", *facts.columns)]
        if any(len(t) < GRAM for t in low):
            parts.append(facts.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("term")) for i, t in enumerate(low) if len(t) < GRAM]))).select("t.*", *facts.columns).filter(holds))
        return reduce(DataFrame.unionByName, parts)


def per_source(hits: DataFrame, *order: str, most: int = PER_SOURCE) -> DataFrame:
    """At most so many hits of each term and source, in that order, with their rank."""
    by = W.partitionBy("term_no", "source").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def capped(hits: DataFrame, sources: list[str], key: list[str], most: int = IN_ALL) -> DataFrame:
    """Hits term by term, source by source, each record once, so many in all."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    first = W.partitionBy("source", *key).orderBy("term_no", "rank")
    once = hits.withColumns({"place": place, "again": F.row_number().over(first)}).filter("again = 1")
    return once.orderBy("term_no", "place", "rank").limit(most).drop("place", "again")

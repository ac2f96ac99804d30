"""Joins beyond equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(inner: DataFrame, outer: DataFrame, key: str, cell: int = 64) -> DataFrame:
    """Each row of ``inner`` (key, start, end) with the rows of ``outer`` (key, unit, unit_start, unit_end) that contain it.

    An equality join on the key and on cells of ``cell`` places: an outer row stands in every cell it covers, an inner row in that of its start.
    """
    cells = F.sequence(F.floor(F.col("unit_start") / cell), F.floor(F.col("unit_end") / cell))
    dealt = outer.filter("unit_start <= unit_end").withColumn("__cell", F.explode(cells))
    placed = inner.withColumn("__cell", F.floor(F.col("start") / cell))
    return placed.join(dealt, [key, "__cell"]).filter("start >= unit_start AND end <= unit_end").drop("__cell")


def touching(relations: DataFrame, units: DataFrame, source: str, target: str, unit: str) -> DataFrame:
    """Relations either end of which is a unit, in any case: two equality joins instead of one on either."""
    name = F.upper(F.col(unit))
    ends = [relations.join(units.select(F.col(unit), name.alias("__u")), F.upper(relations[c]) == F.col("__u")).drop("__u") for c in (source, target)]
    return ends[0].unionByName(ends[1]).distinct()


def containing(longs: DataFrame, long: str, shorts: DataFrame, short: str) -> DataFrame:
    """Rows of ``longs`` with those of ``shorts`` whose name they contain, in any case. Empty and null names are contained in none.

    A short name is looked up by its rarest trigram among the long ones (by itself, if it has no more than three characters), and
    confirmed on the whole: candidates are as many as hold that trigram, not all pairs.
    """
    low = lambda c: F.lower(F.col(c))
    names = shorts.select(low(short).alias("__short")).filter("__short <> ''").distinct()
    pieces = lambda c, n: F.array_distinct(F.transform(F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(n))))
    # pieces of one and two characters only where a name is that short
    lengths = {r["n"] for r in names.select(F.least(F.length("__short"), F.lit(3)).alias("n")).distinct().collect()}
    texts = longs.select(low(long).alias("__long")).filter("__long IS NOT NULL").distinct()
    held = texts.select("__long", F.explode(F.array_distinct(F.concat(*[pieces(F.col("__long"), n) for n in sorted(lengths)]))).alias("__piece")) if lengths else texts.select("__long", F.lit(None).cast("string").alias("__piece")).limit(0)
    asked = names.select("__short", F.explode(pieces(F.col("__short"), 3)).alias("__piece")).unionByName(names.filter(F.length("__short") < 3).select("__short", F.col("__short").alias("__piece")))
    counted = held.join(asked.select("__piece").distinct(), "__piece", "left_semi").groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = asked.join(counted, "__piece", "left").groupBy("__short").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece"))).alias("r")).filter("r.n > 0").select("__short", F.col("r.__piece").alias("__piece"))
    pairs = held.join(rarest, "__piece").filter(F.contains("__long", F.col("__short"))).select("__long", "__short")
    return longs.withColumn("__long", low(long)).join(pairs, "__long").join(shorts.withColumn("__short", low(short)), "__short").drop("__long", "__short")


def ending(longs: DataFrame, long: str, shorts: DataFrame, short: str) -> DataFrame:
    """Rows of ``longs`` with those of ``shorts`` that they end with, in any case: one equality for each length that a short name has."""
    low = lambda c: F.lower(F.col(c))
    named = shorts.withColumn("__end", low(short)).filter("__end <> ''")
    lengths = sorted(r["n"] for r in named.select(F.length("__end").alias("n")).distinct().collect())  # lengths of names
    if not lengths:
        return longs.join(named, F.lit(False)).drop("__end")
    ends = F.array_compact(F.array(*[F.when(F.length(long) >= n, F.right(low(long), F.lit(n))) for n in lengths]))
    return longs.withColumn("__end", F.explode(ends)).join(named, "__end").drop("__end")


def with_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``files`` (file_name) with the package of the very name, in any case; without one, the first by name whose stem they contain."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    of = packages.select(F.col("file_name").alias("package"), stem(F.col("file_name")).alias("stem"), F.lower("file_name").alias("whole"))
    exact = of.groupBy("whole").agg(F.min("package").alias("exact"))
    inside = containing(files.select("file_name").distinct(), "file_name", of.select("package", "stem"), "stem").groupBy("file_name").agg(F.min("package").alias("inside"))
    told = files.withColumn("whole", F.lower("file_name")).join(exact, "whole", "left").join(inside, "file_name", "left")
    how = F.when(F.col("exact").isNotNull(), "name").when(F.col("inside").isNotNull(), "contains")
    return told.select(*files.columns, F.coalesce("exact", "inside").alias("package"), how.alias("matched"))


def in_catalogue(cited: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Of the sources (answer, source) those that end with a name of the catalogue (file_name), in any case; of an answer of which none does, all but dummies."""
    known = ending(cited.select("source").distinct(), "source", catalogue.select("file_name").distinct(), "file_name").select("source", F.lit(True).alias("known")).distinct()
    told = cited.join(known, "source", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    some = told.groupBy("answer").agg(F.max("known").alias("some"))
    kept = F.when(F.col("some"), F.col("known")).otherwise(~F.contains(F.lower("source"), F.lit("dummy")))
    return told.join(some, "answer").filter(kept).select("answer", "source")

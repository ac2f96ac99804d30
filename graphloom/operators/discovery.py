"""Relationships across files: entities of different files whose names normalise alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalised_name


def shared_names(entities: DataFrame) -> DataFrame:
    """Normalised names that stand in two files at least, with their files and entities. ``entities``: id, name, source_file."""
    named = entities.filter("name IS NOT NULL AND source_file IS NOT NULL").withColumn("norm", normalised_name(F.col("name"))).filter("norm <> ''")
    return named.groupBy("norm").agg(F.countDistinct("source_file").alias("files"), F.countDistinct("id").alias("entities")).filter("files >= 2")


def candidate_pairs(entities: DataFrame) -> DataFrame:
    """Every two entities of one normalised name in different files, once: the one of the earlier file, then id, is the source.

    Only names in two files or more take part in the join, and each entity stands in a file once.
    """
    named = entities.filter("name IS NOT NULL AND source_file IS NOT NULL").withColumn("norm", normalised_name(F.col("name"))).filter("norm <> ''")
    seen = named.groupBy("norm", "id", "source_file").agg(F.min("name").alias("name"))
    live = seen.join(shared_names(entities).select("norm"), "norm", "left_semi")
    a = live.select("norm", F.col("id").alias("source_entity_id"), F.col("source_file").alias("source_file"))
    b = live.select("norm", F.col("id").alias("target_entity_id"), F.col("source_file").alias("target_file"))
    return a.join(b, "norm").filter("source_file < target_file AND source_entity_id <> target_entity_id")


def classified(pairs: DataFrame) -> DataFrame:
    """The deterministic class of a pair by the kinds of its files, with its confidence."""
    a, b = F.col("source_file"), F.col("target_file")
    feeds = (a.contains(".dtsx") & b.contains(".sql")) | (a.contains(".sql") & b.contains(".dtsx"))
    derives = F.lower(a).contains(".cbl") | F.lower(b).contains(".cbl")
    kind = F.when(feeds, "FEEDS_INTO").when(derives, "DERIVES_FROM").otherwise("SEMANTICALLY_EQUIVALENT_TO")
    return pairs.withColumns({"relationship_type": kind, "confidence": F.lit(0.7)})


def confirmed(relations: DataFrame, least: float = 0.6) -> DataFrame:
    """Without unrelated pairs and those of low confidence; without a type is unrelated, without a confidence 0."""
    return relations.filter((F.coalesce("relationship_type", F.lit("UNRELATED")) != "UNRELATED") & (F.coalesce("confidence", F.lit(0.0)) >= least))

"""Scans of source files, packages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.vocabulary import CHUNK_EXTENSIONS, EXTENSIONS
from graphloom.operators.windows import first_of_each

#: A knowledge package, as far as the graph and the evidence need it.
PACKAGE = "package_id string, source struct<file_path:string,file_name:string,source_type:string,file_extension:string,total_lines:int,size_bytes:bigint>, summary struct<purpose:string,high_level_narrative:string,business_domain:string,inputs:array<string>,outputs:array<string>,key_transformations:array<string>,key_dependencies:array<string>,business_rules:array<string>>, entities array<struct<name:string,entity_type:string,parent_entity:string,data_type:string,line_number:int,description:string>>, relationships array<struct<source:string,target:string,relationship_type:string,confidence:double,evidence_line:int,description:string>>, transformations array<struct<rule_id:string,rule_type:string,description:string,source_entities:array<string>,target_entities:array<string>,expression:string,line_number:int,confidence:double>>, graph_nodes array<struct<id:string,label:string,properties:map<string,string>>>, graph_edges array<struct<source_id:string,target_id:string,type:string,properties:map<string,string>>>, _corrupt_record string"


def scan(spark: SparkSession, *folders: str, extensions: tuple[str, ...] = tuple(CHUNK_EXTENSIONS)) -> DataFrame:
    """Files under the folders whose extension, in any case, is wanted: path, file_name, size_bytes, text and lines.

    Bytes are read as UTF-8 with replacement; a byte-order mark is taken off.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    name = F.substring_index(F.regexp_replace("path", r"/+$", ""), "/", -1)
    some = raw.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("length").alias("size_bytes"), "content").filter(T.suffix_of(F.col("file_name")).isin(*extensions))
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return some.select("path", "file_name", "size_bytes", text.alias("text")).withColumn("total_lines", F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)))


def distinct_files(files: DataFrame) -> DataFrame:
    """Of files with one name the one with the longest path, then the last path."""
    return first_of_each(files, ["file_name"], F.desc(F.length("path")), F.desc("path"))


def catalogue(files: DataFrame, priority: Column) -> DataFrame:
    """Of files with one name the one in the folder that comes first; with the technology of each."""
    kept = first_of_each(files.withColumn("priority", priority), ["file_name"], "priority", "path")
    return kept.withColumn("technology", F.coalesce(T.source_type(F.col("file_name")), F.lit("unknown"))).drop("priority")


def inline(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Texts that are given as such, under the names they are given."""
    return spark.createDataFrame(list(sources.items()), "file_name string, text string")


def looks_like_sql(c: Column) -> Column:
    return c.rlike(r"(?i)\b(SELECT|FROM|INSERT|UPDATE|CREATE|WITH)\b")


def classified(files: DataFrame) -> DataFrame:
    """Files with their source type; those of an unknown kind are told apart by ``supported``."""
    return files.withColumn("source_type", T.source_type(F.col("file_name"))).withColumn("supported", T.suffix_of(F.col("file_name")).isin(*EXTENSIONS))


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge packages of a folder; a file that can't be read is a row with ``_corrupt_record``."""
    return spark.read.schema(PACKAGE).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*_knowledge_package.json").json(folder).withColumn("path", F.col("_metadata.file_path"))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summary texts of a folder with the stem of the file that each is about."""
    files = spark.read.option("pathGlobFilter", "*_summary.md").text(folder, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), "_summary\\.md$", "").alias("stem"), F.col("value").alias("text"))


def valid_upload(file_name: Column, size: Column) -> Column:
    """Whether a file may be added: a plain name with a known extension, and not empty."""
    return F.coalesce(~file_name.contains("..") & ~file_name.rlike(r"[/\\]") & T.suffix_of(file_name).isin(*EXTENSIONS, ".xml", ".txt") & (size > 0), F.lit(False))

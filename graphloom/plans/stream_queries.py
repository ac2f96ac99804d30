"""Streams over the tables, run to their end, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.tables import table
from graphloom.session import shared_folder
from graphloom.streaming.by_file import analyse_by_file

WAVES = 3


def file_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as versions of files that come in three waves, up to two versions of a file in each: what was analysed, and why."""
    text = F.when(F.col("doc_id") % 5 < 2, F.lit("one text of many")).otherwise(F.coalesce("text", F.lit("")))
    number = F.floor(F.col("doc_id") / 6)
    versions = table(spark, d, "documents").select(F.concat(F.lit("f"), number, F.lit(".sql")).alias("file_name"), F.col("doc_id").alias("version"), text.alias("text"), F.floor((F.col("doc_id") % 6) / 2).alias("wave"))
    folder, store, checkpoint = (shared_folder(spark, x) for x in ("waves", "versions", "versions-progress"))
    for wave in range(WAVES):
        versions.filter(F.col("wave") == wave).drop("wave").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("file_name string, version bigint, text string").parquet(folder)
        analyse_by_file(stream, store, lambda files: files.select("file_name", "version", "change", "content_key", F.length("text").alias("n_chars")), checkpoint).awaitTermination()
    return spark.read.parquet(store).drop("batch")


FILE_VERSIONS = r"""WITH v AS (SELECT 'f' || doc_id // 6 || '.sql' AS file_name, doc_id AS version, doc_id % 6 // 2 AS wave, CASE WHEN doc_id % 5 < 2 THEN 'one text of many' ELSE coalesce(text, '') END AS text FROM documents),
k AS (SELECT file_name, wave, max(version) AS version, arg_max(text, version) AS text FROM v GROUP BY 1, 2),
h AS (SELECT *, sha256(replace(text, E'\r\n', E'\n'))[1:12] AS content_key FROM k),
l AS (SELECT *, lag(content_key) OVER (PARTITION BY file_name ORDER BY wave) AS known FROM h)
SELECT file_name, version, CASE WHEN known IS NULL THEN 'NEW' ELSE 'CHANGED' END AS change, content_key, length(text)::INT AS n_chars FROM l WHERE known IS NULL OR known <> content_key"""

QUERIES = {"file_versions": (file_versions, FILE_VERSIONS)}

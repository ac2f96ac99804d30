"""Streams: files analysed anew only when their content changes, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import content_key


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (file_name, text) whose content key is not among the known (file_name, content_key): only the very content counts."""
    keyed = files.withColumn("content_key", content_key(F.col("text")))
    return keyed.join(known.select("file_name", "content_key"), ["file_name", "content_key"], "left_anti")


def analyse_incrementally(stream: DataFrame, store: str, analyse: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append the analysis of new content to ``store``; content that is known is passed over, also when a batch is run again."""

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        try:
            known = spark.read.parquet(store).select("file_name", "content_key")
        except Exception as error:  # the store begins with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = spark.createDataFrame([], "file_name string, content_key string")
        analyse(changed(files.dropDuplicates(["file_name", "text"]), known)).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in tumbling windows; repeated events count once, late ones up to the watermark. Streams and tables alike."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    once = seen.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else seen.dropDuplicates(["event_id"])
    counted = once.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come, whole."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))

"""Files analysed anew when their content changes, with the last content of each file as keyed state instead of a look into the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from graphloom.functions.text import content_key

#: State of many files lives on the disks of the executors, its changes beside the checkpoint of the stream.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "file_name string, version bigint, content_key string, text string, change string"


class LastContent(StatefulProcessor):
    """Of a file's rows in a batch the last by version, then content, if it is not what is known; NEW or CHANGED."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle) -> None:
        self._known = handle.getValueState("known", "content_key string", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for part in rows:
            top = part.sort_values(["version", "content_key"], kind="stable").iloc[-1]
            if last is None or (top["version"], top["content_key"]) >= (last["version"], last["content_key"]):
                last = top
        if last is None:
            return
        known = self._known.get() if self._known.exists() else None
        if known is not None and known[0] == last["content_key"]:
            return
        self._known.update((last["content_key"],))
        yield pd.DataFrame([(key[0], last["version"], last["content_key"], last["text"], "NEW" if known is None else "CHANGED")], columns=["file_name", "version", "content_key", "text", "change"])

    def close(self) -> None:
        pass


class Progress(StreamingQueryListener):
    """Batches, rows in and files held in state of the streams of a session, by the name of the query."""

    def __init__(self) -> None:
        self.of: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        so_far = self.of.setdefault(p.name or str(p.id), {"batches": 0, "rows": 0, "files": 0})
        so_far["batches"] += 1
        so_far["rows"] += p.numInputRows
        so_far["files"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def changes(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """New and changed files of a stream of (file_name, version, text); versions grow with time, a null text is empty.

    Rows without a file name are no file. Work and shuffle grow with what arrives, not with what has been analysed. State that no change
    has touched for ``ttl_ms`` goes, and the file counts as new when it comes again.
    """
    keyed = stream.filter("file_name IS NOT NULL").select("file_name", F.coalesce(F.col("version").cast("long"), F.lit(0).cast("long")).alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("content_key", content_key(F.col("text")))
    return keyed.groupBy("file_name").transformWithStateInPandas(LastContent(ttl_ms), _OUT, "Update", "ProcessingTime" if ttl_ms else "None")


def analyse_by_file(stream: DataFrame, store: str, analyse: Callable[[DataFrame], DataFrame], checkpoint: str, ttl_ms: int | None = None, name: str | None = None, every: str = "1 minute") -> StreamingQuery:
    """Write the analysis of new and changed files to ``store``, a folder a batch; a batch that is run again replaces its folder.

    ``analyse`` keeps file_name. Without ``ttl_ms`` the query ends with what is there; with it, it runs ``every`` so often until it is
    stopped, as state can go at any time.
    """
    def batch(files: DataFrame, number: int) -> None:
        analyse(files).write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = changes(stream, ttl_ms).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if ttl_ms else writer.trigger(availableNow=True)
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, PROVIDER)  # a query keeps the settings that it begins with
    try:
        return (writer.queryName(name) if name else writer).start()
    finally:
        conf.set(key, before)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The analysis of each file by the last batch that had it."""
    rows = spark.read.parquet(store)
    last = rows.groupBy("file_name").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file_name", "batch"], "left_semi").drop("batch")

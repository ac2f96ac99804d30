"""Session defaults."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(name: str = "graphloom", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


def with_checkpoints(spark: SparkSession) -> None:
    """The checkpoint folder that the cluster names; a folder of this machine only where all tasks run on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for files that driver and executors share, below the checkpoint folder; it goes when the session's Python ends."""
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def settled(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once as Parquet, so that each of many readers takes only the columns it asks for."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; what is left lies in the checkpoint folder
        return

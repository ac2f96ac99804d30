"""Helpers that several training-data operators use: reading tables, cutting lineage, weighing sizes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = r"[\x20\x09-\x0D]+"
WORD_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all tasks run on this machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; what is left lies in the checkpoint folder
        return


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut and a lost executor costs nothing before it.

    The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, file)


def narrow(df: DataFrame, *names: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of the caller cannot interfere; a missing one is null.

    Those in ``carry`` come along as "carried 0" and so on; ``carried`` names them back.
    """
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names], *[F.col(f"`{c}`").alias(f"carried {i}") for i, c in enumerate(carry)])


def carried(carry: tuple[str, ...]) -> list[Column]:
    return [F.col(f"carried {i}").alias(c) for i, c in enumerate(carry)]


def handed_out(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df``, known to have at most ``rows`` rows, to be broadcast if those are few; else it is joined by its keys."""
    return F.broadcast(df) if rows <= most else df


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no label may be learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def capped(df: DataFrame, key: Column, most: int) -> DataFrame:
    """All rows, or about ``most`` of them, those with the smallest hashes: a bounded sample to fit a model on."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))

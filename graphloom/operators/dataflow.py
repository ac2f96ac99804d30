"""Building blocks of data flows: look-ups, splits, merges of two files, and the calculations made along the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.windows import first_of_each


def lookup(rows: DataFrame, reference: DataFrame, on: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a match in ``reference`` and rows to redirect."""
    return rows.join(reference, on, "left_semi"), rows.join(reference, on, "left_anti")


def split(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition and all others; what is null is not met."""
    met = F.coalesce(valid, F.lit(False))
    return rows.filter(met), rows.filter(~met)


def quarantine(*streams: tuple[str, DataFrame]) -> DataFrame:
    """Error streams on top of each other, with the reason of each."""
    out = None
    for reason, rows in streams:
        part = rows.withColumn("reason", F.lit(reason))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def match_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two files of one row per key: matched, missing in b, or orphan of b."""
    left, right = a.withColumn("__a", F.lit(1)), b.withColumn("__b", F.lit(1))
    state = F.when(F.col("__b").isNull(), "MISSING").when(F.col("__a").isNull(), "ORPHAN").otherwise("MATCHED")
    return left.join(right, key, "full_outer").withColumn("match_state", state).drop("__a", "__b")


def keyed_load(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the rows that are rejected: later ones and those without a key."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    first = first_of_each(rows.filter(~blank), [key], *order)
    later = rows.filter(~blank).exceptAll(first).withColumn("reject", F.lit("DUPLICATE"))
    return first, later.unionByName(rows.filter(blank).withColumn("reject", F.lit("BLANK")))


def ratio_percent(part: Column, whole: Column) -> Column:
    """Part as per cent of the whole; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part / whole * 100)


def earned(written: Column, begin: Column, end: Column, upto: Column) -> Column:
    """The part of a premium that is earned up to a day: both ends count as days, never under 0 or over what is written."""
    days = F.date_diff(end, begin) + 1
    gone = F.least(F.greatest(F.date_diff(upto, begin) + 1, F.lit(0)), days)
    return F.when(days <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.round(written * gone / days, 2), F.lit(0)), written)).cast("decimal(18,2)")


def valid_date(c: Column) -> Column:
    """Whether eight digits are a day of the calendar."""
    return c.rlike(r"^\d{8}$") & F.try_to_date(c, "yyyyMMdd").isNotNull() if hasattr(F, "try_to_date") else c.rlike(r"^\d{8}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull()


def policy_status(status: Column, begin: Column, end: Column, today: Column) -> Column:
    """Cancelled stays; pending before the begin, expired after the end, active in between."""
    return F.when(status == "CN", "CN").when(today < begin, "PN").when(today > end, "EX").otherwise("AC")

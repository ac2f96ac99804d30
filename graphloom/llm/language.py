"""Language of web pages by Bayesian evidence fusion.

The evidence: likelihoods of the main text under byte-trigram models, the language the markup declares (weighed by how often such
declarations agree with the text), and a prior from the address - host within domain within suffix within all pages - whose counts
are grouped sums of text posteriors, each level smoothed towards the one above. A page is left out of its own prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.extraction import blocks, main_text
from graphloom.llm.shared import narrow, settle

CELLS = 1 << 15
#: Labelled texts of a language that its model is fitted on at most, about.
MAX_FIT = 1500
#: More distinct values than this are no languages: an error, as a model takes 128 KiB of every task for each.
MAX_LANGUAGES = 8192
#: Groups that the texts of a language are counted in.
SHARDS = 8
#: Neighbouring trigrams overlap: their likelihood counts by this share, and no text outweighs the rest by more than this.
TEMPER, MOST = 1 / 3, 30.0
#: Pages' worth of weight that the level above has in a prior.
SMOOTH = 4.0
#: Weight of an even table in the reliability of declarations.
DECLARED_SMOOTH = 2.0

#: Numbers that are handed to all tasks at most; larger tables are joined.
MAX_BROADCAST_NUMBERS = 1_000_000
#: Pages of one address part beyond which its counts are broadcast to them, so that no task has all of them.
HOT_PAGES = 10_000
#: Labels that registries of countries put before their own, so that a domain below them has three labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ne", "net", "or", "org")

_DECLARED = re.compile(r"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([a-zA-Z]{2,3})\b|<meta\b[^>]*?content-language["']?[^>]*?content\s*=\s*["']?([a-zA-Z]{2,3})\b""", re.I)


def trigrams(text: str) -> np.ndarray:
    """Cells of the byte trigrams of a text, in lower case, white space as one space."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.empty(0, np.int64)
    return ((((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _counts(part: pa.Table) -> pa.Table:
    held = np.zeros(CELLS, np.int64)
    for text in part.column("text"):
        held += np.bincount(trigrams(text.as_py() or ""), minlength=CELLS)
    return pa.table({"lang": pa.array([part.column("lang")[0].as_py()], pa.string()), "counts": pa.array([held.tobytes()], pa.binary())})


def _logs(part: pa.Table) -> pa.Table:
    held = sum(np.frombuffer(c.as_py(), np.int64) for c in part.column("counts"))
    logs = np.log((held + 0.5) / (held.sum() + 0.5 * CELLS)).astype(np.float32)
    return pa.table({"lang": pa.array([part.column("lang")[0].as_py()], pa.string()), "logs": pa.array([logs.tobytes()], pa.binary())})


def fit_models(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of ``labelled`` (text, lang) by name and the log-probabilities (CELLS, languages) of their trigrams.

    Counts of a hash sample of each language are summed in tasks; one row a language comes to the driver.
    """
    named = labelled.filter("lang IS NOT NULL").select("text", "lang")
    hashed = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not sizes:
        return [], np.zeros((CELLS, 0), np.float32)
    bars = named.sparkSession.createDataFrame([(r["lang"], max(r["least"], int(1_000_000 * min(1.0, MAX_FIT / r["n"])))) for r in sizes], "lang string, bar long")
    some = named.join(F.broadcast(bars), "lang").filter(hashed <= F.col("bar")).select("lang", "text").distinct()  # copies count once
    some = some.withColumn("shard", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SHARDS)))
    counts = some.groupBy("lang", "shard").applyInArrow(_counts, "lang string, counts binary")
    rows = sorted(counts.groupBy("lang").applyInArrow(_logs, "lang string, logs binary").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.column_stack([np.frombuffer(r["logs"], np.float32) for r in rows])


def _evidence(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = models.value
        for batch in batches:
            declared, likelihood = [], []
            for page in batch.column(2):
                page = page.as_py() or ""
                m = _DECLARED.search(page)
                declared.append((m[1] or m[2]).lower() if m else None)
                cells = trigrams(main_text(page) or " ".join(b.text for b in blocks(page)))
                kinds, times = np.unique(cells, return_counts=True)  # a long text too has at most CELLS kinds
                logs = times.astype(np.float64) @ table[kinds] * TEMPER
                likelihood.append(np.maximum(logs - logs.max(initial=-np.inf), -MOST) if logs.size else logs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(likelihood, pa.list_(pa.float64()))], ["page_id", "url", "declared", "likelihood"])

    return run


def _sum(column: str) -> Column:
    """Element-wise sum of arrays of one length, whatever that is: one aggregate, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def _with_counts(pages: DataFrame, sums: DataFrame, level: str, rows: int, n: int) -> DataFrame:
    """``pages`` with counts and n of their part of the address. Counts of parts with very many pages are broadcast, at most
    ``MAX_BROADCAST_NUMBERS`` numbers of them; their pages take a key of their own in the join of the rest.
    """
    most = max(1, MAX_BROADCAST_NUMBERS // n)
    least = max(HOT_PAGES, rows // most)
    hot = sums.filter(F.col("n") > least).select(level, F.col("counts").alias("hot_counts"), F.col("n").alias("hot_n"))
    rest = sums.filter(F.col("n") <= least).withColumnRenamed(level, "part")
    told = pages.join(F.broadcast(hot), level, "left")
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)).cast("string"))
    told = told.withColumn("part", F.when(F.col("hot_n").isNull() & (F.col(level) != ""), F.col(level)).otherwise(spread))
    told = told.join(rest, "part", "left")
    return told.withColumns({"counts": F.coalesce("hot_counts", "counts"), "n": F.coalesce("hot_n", "n")}).drop("part", "hot_counts", "hot_n")


def _normalised(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def identify_language(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, declared, text_lang (by the text alone), lang and posterior.

    Null or empty pages have no text likelihood and no declaration: the prior of their address decides. Pages without an address use
    the prior of all pages. Ties go to the first language by name; without labelled texts lang is null. Very long pages are counted
    by kinds of trigrams. More than MAX_LANGUAGES values of lang raise an error.
    """
    langs, table = fit_models(narrow(labelled, "text", "lang"))
    pages = narrow(pages, "page_id", "url", "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, declared string, likelihood array<double>"
    models = pages.sparkSession.sparkContext.broadcast(table)
    seen = pages.mapInArrow(_evidence(models), schema)
    if not langs:
        return seen.select("page_id", "url", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    names, n = F.array(*[F.lit(x) for x in langs]), len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    seen = seen.withColumn("host", host).withColumns({"domain": F.regexp_extract("host", rf"((?:[^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+\.[^.]+))$", 1), "suffix": F.regexp_extract("host", r"([^.]+)$", 1)})
    seen = seen.withColumn("text_posterior", _normalised(F.col("likelihood")))
    named = lambda p: F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)
    seen = settle(seen.withColumn("text_lang", named(F.col("text_posterior"))), "evidence")
    every = seen.groupBy(F.lit(1)).agg(_sum("text_posterior").alias("counts"), F.count(F.lit(1)).alias("n")).first()
    rows, all_counts = (every["n"], every["counts"]) if every else (0, [0.0] * n)

    # how often a language is declared where the text speaks another
    seen = seen.withColumn("told", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), "other"))
    pairs = settle(seen.filter("told IS NOT NULL").groupBy("told").agg(_sum("text_posterior").alias("counts")), "declared")
    spoken = pairs.groupBy(F.lit(1)).agg(_sum("counts").alias("counts")).first()
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    spoken = numbers(spoken["counts"] if spoken else [0.0] * n)
    reliability = pairs.select("told", F.zip_with("counts", spoken, lambda c, all_: F.log((c + DECLARED_SMOOTH / (n + 1)) / (all_ + DECLARED_SMOOTH))).alias("by_declared"))
    reliability = F.broadcast(reliability) if n * (n + 1) <= MAX_BROADCAST_NUMBERS else reliability

    minus = lambda counts: F.zip_with(counts, "text_posterior", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    out = seen.join(reliability, "told", "left").withColumn("by_declared", F.coalesce("by_declared", F.array_repeat(F.lit(0.0), n)))
    count, own = numbers(all_counts), F.lit(float(rows))
    prior = F.transform(minus(count), lambda c: (c + SMOOTH / n) / (own - 1 + SMOOTH))
    for level in ("suffix", "domain", "host"):
        sums = settle(seen.filter(F.col(level) != "").groupBy(level).agg(_sum("text_posterior").alias("counts"), F.count(F.lit(1)).alias("n")), level)
        out = _with_counts(out.withColumn("above", prior), sums, level, rows, n)
        prior = F.when(F.col("counts").isNull(), F.col("above")).otherwise(F.zip_with(minus(F.col("counts")), "above", lambda c, a: (c + SMOOTH * a) / (F.col("n") - 1 + SMOOTH)))
        out = out.withColumn("prior", prior).drop("above", "counts", "n")
        prior = F.col("prior")
    fused = F.zip_with(F.zip_with(F.transform("prior", lambda p: F.log(p)), "likelihood", lambda a, b: a + b), "by_declared", lambda a, b: a + b)
    out = out.withColumn("fused", fused).withColumn("posterior_all", _normalised(F.col("fused")))
    return out.select("page_id", "url", "declared", "text_lang", named(F.col("posterior_all")).alias("lang"), F.round(F.array_max("posterior_all"), 6).alias("posterior"))

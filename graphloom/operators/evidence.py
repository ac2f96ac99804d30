"""Evidence under budgets: bounded heads of each kind with the totals behind them, and contexts packed to so many characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of a kind in a head, and characters of a preview; evidence of a kind in a context; characters of an excerpt.
HEAD, PREVIEW = 10, 300
GRAPH_EVIDENCE, VECTOR_EVIDENCE, EXCERPT = 15, 8, 500
BETWEEN = "\n\n"


def heads(facts: DataFrame, keys: list[str], text: str, *order: str, most: int = HEAD, preview: int = PREVIEW) -> DataFrame:
    """Per key: total, and the previews of its first ``most`` facts in order.

    Rows beyond the head are dropped in each task before the shuffle, as only ranks up to ``most`` are asked for; totals are counted
    apart, so no key brings all its facts together.
    """
    totals = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    ranked = facts.select(*keys, *[c for c in order if c not in keys], F.substring(F.coalesce(text, F.lit("")), 1, preview).alias("__preview")).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order, "__preview"))).filter(F.col("__n") <= most)
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", "__preview"))).alias("__h"))
    same = [totals[k].eqNullSafe(first[k]) for k in keys]
    return totals.join(first, reduce(lambda a, b: a & b, same)).select(*[totals[k] for k in keys], "total", F.col("__h.__preview").alias("head"), (F.col("total") > most).alias("more"))


def excerpt(file_name: Column, score: Column, text: Column) -> Column:
    """How a passage found by its vector is shown: file, score with three decimals, and how it begins."""
    return F.concat(F.format_string("[%s | score=%.3f]\n", F.coalesce(file_name, F.lit("")), F.coalesce(score, F.lit(0.0))), F.substring(F.coalesce(text, F.lit("")), 1, EXCERPT))


def packed(evidence: DataFrame, key: str, text: str, *order: str, budget: int) -> DataFrame:
    """Per key: its evidence in order, joined and cut after ``budget`` characters: (key, context, items, whole).

    Running sums of lengths tell where each piece begins; what begins beyond the budget is left out before pieces are gathered, so a
    context gathers at most ``budget`` characters and as many pieces, however much evidence there is. ``items`` begin within it; it
    is ``whole`` if nothing was cut. Empty pieces are none.
    """
    pieces = evidence.filter(F.coalesce(F.col(text), F.lit("")) != "")
    by = W.partitionBy(key).orderBy(*order, text)
    size = F.length(text) + len(BETWEEN)
    placed = pieces.withColumns({"__end": F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0)), "__n": F.row_number().over(by)}).withColumn("__begin", F.col("__end") - size)
    # one more piece may begin behind the budget, if what stands before it is cut by it
    inside = placed.filter(F.col("__begin") < budget + len(BETWEEN)).select(key, "__n", (F.col("__begin") < budget).alias("__in"), F.substring(text, F.lit(1), F.greatest(budget - F.col("__begin"), F.lit(0)).cast("int")).alias("__part"))
    ends = placed.groupBy(key).agg(F.max("__end").alias("__all"))
    joined = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", "__part"))).alias("__p"), F.sum(F.col("__in").cast("int")).cast("int").alias("items"))
    context = F.substring(F.array_join(F.col("__p.__part"), BETWEEN), 1, budget)
    return joined.join(ends, key).select(key, context.alias("context"), "items", (F.col("__all") - len(BETWEEN) <= budget).alias("whole"))


def answer_context(graph: DataFrame, vector: DataFrame, key: str, budget: int) -> DataFrame:
    """Contexts of questions: the first graph evidence (key, rank, text), then the first vector evidence (key, rank, file_name, score, text)."""
    of_graph = graph.filter(F.col("rank") <= GRAPH_EVIDENCE).select(key, F.lit(0).alias("kind"), "rank", F.col("text").alias("piece"))
    of_vector = vector.filter(F.col("rank") <= VECTOR_EVIDENCE).select(key, F.lit(1).alias("kind"), "rank", excerpt(F.col("file_name"), F.col("score"), F.col("text")).alias("piece"))
    return packed(of_graph.unionByName(of_vector), key, "piece", "kind", "rank", budget=budget)

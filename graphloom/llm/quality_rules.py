"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

``text_statistics`` counts, ``fit_mcd`` estimates a centre and a covariance per language and source from the
most concentrated share of the rows, ``quality_rules`` rejects rows at too large a Mahalanobis distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import WORD_SPACE, WORD_SPACE_CHARS, carried, handed_out, narrow, settle

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: The statistic vector, after its transformation; see ``vectors``.
DIMENSIONS = ("symbol", "upper", "repeat", "line", "length")
#: Least standard deviation of each, in transformed units. Statistics that are 0 in most rows would else have no spread.
FLOORS = (0.03, 0.05, 0.06, 0.08, 0.06)
#: Share of the rows of a group that the estimate rests on.
SUPPORT = 0.6
#: Factor that makes the covariance of the closest SUPPORT of a 5-variate normal consistent:
#: 0.6 / P(chi2 with 7 degrees <= 5.1319), 5.1319 being the 0.6 quantile with 5 degrees.
CONSISTENCY = 1.685
#: Squared distance beyond which a row is rejected.
CUTOFF = 68.0
#: Groups with fewer rows take the estimate of their language, and those of all rows after that.
MIN_GROUP = 100
STEPS = 4
#: Estimates that are broadcast at most; more are joined by their keys. An estimate has 23 numbers.
MAX_BROADCAST_GROUPS = 100_000
#: Bins of a squared distance per factor e; the closest rows are told by bins, not by sorting.
BINS = 64


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_letters.

    Null and empty texts count as no words. Windows of five words are told apart by 64-bit hashes.
    """
    trimmed = F.btrim("__text", F.lit(WORD_SPACE_CHARS))
    out = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumn("__words", F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_SPACE, -1)).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.translate(x, WORD_SPACE_CHARS, "")) > 0)
    out = out.withColumn("__lines", lines)
    word = lambda i, k: F.get(F.col("__words"), i + k)
    windows = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__windows", windows)
    n = F.size("__windows")
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < n, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    n = F.size("__sorted")
    repeated = F.zip_with(F.slice("__sorted", 1, F.greatest(n - 1, F.lit(0))), F.slice("__sorted", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__starts", F.sort_array(F.array_distinct(F.flatten(repeated))))
    n = F.size("__starts")
    covered = F.zip_with("__starts", F.slice("__starts", 2, F.greatest(n, F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("bigint"))
    bare = F.translate("__text", WORD_SPACE_CHARS, "")
    return out.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(bare).cast("bigint"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("bigint"), lambda s, x: s + x),
        "n_upper": (F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Lu}", ""))).cast("bigint"),
    }).drop("__text", "__words", "__lines", "__windows", "__sorted", "__starts")


def vectors() -> dict[str, Column]:
    """The transformed statistics: square roots of shares, smoothed by pseudo-counts so that short texts don't stand out by chance."""
    share = lambda part, whole, prior: F.sqrt(F.col(part) / (F.col(whole) + F.lit(prior)))
    return {
        "symbol": share("n_symbols", "word_chars", 100.0),
        "upper": share("n_upper", "word_chars", 100.0),
        "repeat": share("n_repeat_words", "n_words", 20.0),
        "line": share("n_dup_lines", "n_lines", 5.0),
        "length": F.log((F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0)),
    }


def _inverse(cov: dict[tuple[int, int], Column], p: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Columns of the Cholesky factor (to be added one after another), of the inverse factor, and the log-determinant."""
    low: dict[str, Column] = {}
    c = lambda i, j: F.col(f"l{i}{j}")
    for j in range(p):
        low[f"l{j}{j}"] = F.sqrt(cov[j, j] - reduce(lambda a, b: a + b, [c(j, k) * c(j, k) for k in range(j)], F.lit(0.0)))
        for i in range(j + 1, p):
            low[f"l{i}{j}"] = (cov[j, i] - reduce(lambda a, b: a + b, [c(i, k) * c(j, k) for k in range(j)], F.lit(0.0))) / c(j, j)
    inv: dict[str, Column] = {}
    w = lambda i, j: F.col(f"w{i}{j}")
    for j in range(p):
        inv[f"w{j}{j}"] = 1 / c(j, j)
        for i in range(j + 1, p):
            inv[f"w{i}{j}"] = -reduce(lambda a, b: a + b, [c(i, k) * w(k, j) for k in range(j, i)]) / c(i, i)
    return low, inv, reduce(lambda a, b: a + b, [2 * F.log(c(j, j)) for j in range(p)])


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: centre m0.., inverse Cholesky factor w00.. of the floored, consistent covariance, and logdet."""
    p = len(DIMENSIONS)
    cov = {(i, j): CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(p) for j in range(i, p)}
    low, inv, logdet = _inverse(cov, p)
    out = moments
    for step in (low, inv):
        for name, column in step.items():
            out = out.withColumn(name, column)
    return out.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(p)], *inv, logdet.alias("logdet"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(d) for d in DIMENSIONS]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(len(x))]
    products = [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's estimate."""
    p = len(DIMENSIONS)
    dev = [F.col(d) - F.col(f"m{i}") for i, d in enumerate(DIMENSIONS)]
    terms = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * dev[j] for j in range(i + 1)]) for i in range(p)]
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _closest(rows: DataFrame, at: Column, groups: int) -> DataFrame:
    """The SUPPORT of each ``grp`` and ``start`` with the smallest ``at``, to the end of a bin. Counts of bins are all that is shuffled."""
    binned = rows.withColumn("bin", F.floor(F.log(at + 1e-6) * BINS).cast("int"))
    by = W.partitionBy("grp", "start")
    counts = binned.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(by.orderBy("bin"))).withColumn("all", F.sum("c").over(by))
    limits = counts.filter(F.col("upto") >= F.ceil(F.col("all") * SUPPORT)).groupBy("grp", "start").agg(F.min("bin").alias("limit"))
    limits = handed_out(limits.withColumnsRenamed({"grp": "grp_", "start": "start_"}), groups, MAX_BROADCAST_GROUPS)
    return binned.join(limits, (F.col("grp") == F.col("grp_")) & (F.col("start") == F.col("start_"))).filter("bin <= limit").drop("grp_", "start_")


def fit_mcd(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``grp`` by concentration steps from two deterministic starts.

    ``rows`` has grp and the DIMENSIONS. Start 0 is the per-dimension median scaled by the floors, start 1 the
    mean with the full covariance; the smaller determinant wins.
    """
    medians = rows.groupBy("grp").agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"m{i}") for i, d in enumerate(DIMENSIONS)])
    flat = medians.select("grp", *[f"m{i}" for i in range(len(DIMENSIONS))], *[F.lit(1 / FLOORS[i] if i == j else 0.0).alias(f"w{i}{j}") for j in range(len(DIMENSIONS)) for i in range(j, len(DIMENSIONS))])
    full = _estimate(_moments(rows, ["grp"]), ["grp"]).select(*flat.columns)
    fit = flat.withColumn("start", F.lit(0)).unionByName(full.withColumn("start", F.lit(1)))
    for step in range(STEPS):
        fit = settle(fit, f"mcd-{step}")
        groups = fit.count()
        at = rows.join(handed_out(fit.withColumnRenamed("grp", "grp_"), groups, MAX_BROADCAST_GROUPS), F.col("grp") == F.col("grp_")).drop("grp_")
        at = at.select("grp", "start", *DIMENSIONS, distance().alias("d2"))
        fit = _estimate(_moments(_closest(at, F.col("d2"), groups), ["grp", "start"]), ["grp", "start"])
    fit = settle(fit, "mcd")
    best = fit.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return fit.join(best, ["grp", "start"]).drop("start")


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, distance2 and the columns in ``carry``.

    Rows that fail the base rule take no part in the estimates and are not kept. A group is a language and a
    source; null, or fewer than MIN_GROUP rows: the language's estimate, then that of all rows. Each row is judged by itself:
    repeated rows and ids stay, null texts count as empty. Of no usable estimate (no row passes): kept follows the base rule.
    """
    base = text_statistics(narrow(docs, "doc_id", "text", "lang", "source", carry=carry)).drop("text")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    base = settle(base.withColumns(vectors()), "quality")
    by_lang = F.concat(F.lit("L"), F.coalesce("lang", F.lit("")))
    by_source = F.concat(F.lit("S"), F.coalesce("lang", F.lit("")), F.lit("\x00"), F.coalesce("source", F.lit("")))
    passed = base.filter(~F.col("base_failed"))
    sizes = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.select(by_source.alias("grp"), "n").unionByName(sizes.groupBy("lang").agg(F.sum("n").alias("n")).select(by_lang.alias("grp"), "n")).filter(F.col("n") >= MIN_GROUP)
    known = settle(known.select("grp").unionByName(docs.sparkSession.range(1).select(F.lit("A").alias("grp"))), "mcd-groups")
    groups = known.count()
    levels = settle(passed.select(F.explode(F.array(by_source, by_lang, F.lit("A"))).alias("grp"), *DIMENSIONS).join(handed_out(known, groups, MAX_BROADCAST_GROUPS), "grp", "left_semi"), "mcd-rows")
    fit = settle(fit_mcd(levels), "mcd-fit")
    names = [c for c in fit.columns if c != "grp"]
    of_all = fit.filter("grp = 'A'").first()
    level = lambda key, tag: handed_out(fit.withColumnsRenamed({c: f"{tag}{c}" for c in names} | {"grp": key}), groups, MAX_BROADCAST_GROUPS)
    keyed = base.withColumns({"k1": by_source, "k2": by_lang}).join(level("k1", "a_"), "k1", "left").join(level("k2", "b_"), "k2", "left")
    chosen = {c: F.when(F.col("a_n").isNotNull(), F.col(f"a_{c}")).when(F.col("b_n").isNotNull(), F.col(f"b_{c}")).otherwise(F.lit(of_all[c] if of_all else None).cast("double")) for c in names}
    judged = keyed.withColumns(chosen).withColumn("distance2", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    return judged.select(*([] if "doc_id" in carry else ["doc_id"]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance2", 6).alias("distance2"), *carried(carry))

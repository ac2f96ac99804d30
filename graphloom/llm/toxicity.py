"""Toxicity by weak supervision.

Many lexicon and pattern voters vote on every document; a generative label model estimates how accurate they are and how far
they repeat each other, and gives each document a posterior label; a linear classifier is trained on those.
The lexicons beyond the seed words are mined from labelled rows that are not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import capped, carried, held_out, narrow, settle

#: Common insults that need no label.
SEED_WORDS = "clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split()
#: Labelled rows of either class that the lexicons are mined from at most.
MAX_LABELLED = 6000
#: Rows of either posterior class that the classifier is fitted on at most.
MAX_FIT = 5000
MAX_TERMS = 600
#: Least log-odds of a mined term, and least likelihood ratio (G squared), which chance reaches once in 20 million terms.
MIN_ODDS = 2.5
MIN_RATIO = 30.0
PREFIXES = (4, 5, 6, 7, 8)
#: Shares of the words of a text that are lexicon words, two at least; reaching one is a vote. Texts hold single ones by chance.
SHARES = (0.004, 0.008, 0.012)
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote on their own: shouting, exclamation runs, being addressed.
PATTERNS = {"exclaim": r"!{2,}", "shout": r"\b[A-Z]{4,}\b(?:\W+[A-Z]{2,}\b){3,}", "address": r"(?i)\byou(?:r| are|'re)\b"}
_PATTERNS = [re.compile(p) for p in PATTERNS.values()]
_TIERS = 2


def word_terms(word: str) -> list[str]:
    return [word] + [f"{word[:n]}-" for n in PREFIXES if len(word) > n]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a term, per task."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def emit() -> pa.RecordBatch:
        terms = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
        held[0].clear()
        held[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            held[1 if label else 0].update({t for w in words for t in word_terms(w)})
        if len(held[0]) + len(held[1]) > 500_000:
            yield emit()
    yield emit()


def mine_terms(labelled: DataFrame) -> list[tuple[str, float]]:
    """The terms that tell toxic rows of ``labelled`` (text, toxic) best, with their log-odds; seed words are always among them."""
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = labelled.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    a, b = F.col("toxic") + F.lit(0.0), F.col("clean") + F.lit(0.0)
    part = lambda x, n: F.when(x > 0, x * F.log(x / ((a + b) * F.lit(n / max(1, n0 + n1))))).otherwise(0.0)
    scored = counts.filter("toxic > 1").withColumn("odds", odds).withColumn("ratio", 2 * (part(a, n1) + part(b, n0)))
    best = scored.filter((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).collect()
    found = {r["term"]: float(r["odds"]) for r in best}
    return list(found.items()) + [(w, MIN_ODDS) for w in SEED_WORDS if w not in found]


def one_of_each_family(labelled: DataFrame) -> DataFrame:
    """Copies would lend their every word the support of many documents: of texts with the same smallest five-word hash one stays."""
    n = F.size("words")
    hashes = F.when(n > 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))).otherwise(F.array(F.xxhash64("words")))
    worded = labelled.withColumn("words", F.split(F.lower("text"), r"\s+"))
    return worded.withColumn("family", F.array_min(hashes)).drop("words").groupBy("family", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def make_voters(terms: list[tuple[str, float]]) -> tuple[list[str], np.ndarray]:
    """Names of the voters and the voter of each term: kind of term by tier of strength. The seed words have one of their own as well."""
    kinds = [f"prefix{len(t) - 1}" if t.endswith("-") else "word" for t, _ in terms]
    names, of = [], np.zeros(len(terms), np.int64)
    for kind in ("word", *(f"prefix{n}" for n in PREFIXES)):
        own = [i for i, k in enumerate(kinds) if k == kind]
        for tier in range(_TIERS):
            names.append(f"{kind}-{tier}")
            for i in own[tier * len(own) // _TIERS : (tier + 1) * len(own) // _TIERS]:
                of[i] = len(names) - 1
    return [*names, "seed", *[f"share-{x}" for x in SHARES], *PATTERNS, "nothing"], of


def _vote(terms: list[str], of: list[int], n_lexicons: int):
    """doc_id, votes ("+" toxic, "-" clean, "." abstains; one letter a voter) and the numbers of the terms that stand in the text.

    The shares that are reached count as terms too, numbered after the others.
    """
    where = {t: i for i, t in enumerate(terms)}
    seeds = {where[w] for w in SEED_WORDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            votes, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                hits: set[int] = set()
                words = Counter(_WORD.findall(text.lower()))
                spoken = 0
                for w, n in words.items():
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > 300_000:
                            known.clear()
                        ids = known[w] = tuple(where[t] for t in word_terms(w) if t in where)
                    if ids:
                        hits.update(ids)
                        spoken += n
                by = {of[i] for i in hits}
                lexicons = "".join("+" if j in by else "." for j in range(n_lexicons))
                reached = [spoken > 1 and spoken >= x * words.total() for x in SHARES]
                shares = "".join("+" if r else "." for r in reached)
                patterns = "".join("+" if p.search(text) else "." for p in _PATTERNS)
                votes.append(lexicons + ("+" if hits & seeds else ".") + shares + patterns + ("." if hits else "-"))
                found.append(sorted(hits) + [len(terms) + k for k, r in enumerate(reached) if r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string()), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "votes", "terms", *batch.schema.names[2:]])

    return run


def label_model(patterns: list[str], counts: np.ndarray, steps: int = 50) -> np.ndarray:
    """Posterior probability of the toxic class for each pattern of votes.

    Expectation-maximisation over a table P(vote | class) for each voter. Correlations of voters within a class, estimated
    from the posteriors half-way, divide the weight of voters that repeat each other, so that copies of one voter count once.
    """
    outcome = np.array([["-.+".index(v) for v in p] for p in patterns])
    n, m = outcome.shape
    onehot = np.eye(3)[outcome]
    lexicon = m - len(PATTERNS) - 1
    hits = (outcome[:, : lexicon - len(SHARES)] == 2).sum(axis=1)
    post = np.where(outcome[:, lexicon - 1] == 2, 0.95, np.where(hits > 0, 0.1, 0.02))
    weight = np.ones(m)
    for step in range(steps):
        mass = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("yn,njv->yjv", mass, onehot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        # a lexicon's hit never speaks for the clean class: this is what names the classes
        flip = table[1, :lexicon, 2] < table[0, :lexicon, 2]
        table[1, :lexicon][flip] = table[0, :lexicon][flip]
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        if step == steps // 2:
            x = (outcome == 2).astype(float) - (outcome == 0)
            shared = np.zeros((m, m))
            for y in range(2):
                c = mass[y] / max(mass[y].sum(), 1e-9)
                dev = x - c @ x
                cov = (dev * c[:, None]).T @ dev
                sd = np.sqrt(np.diag(cov)) + 1e-9
                shared = np.maximum(shared, np.abs(cov / sd / sd[:, None]))
            np.fill_diagonal(shared, 1.0)
            weight = 1 / shared.sum(axis=1)
        ratio = (np.log(table[1]) - np.log(table[0]))[np.arange(m)[None, :], outcome]
        logit = np.log(prior[1] / prior[0]) + ratio @ weight
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 0.0003, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = w / w.sum()
    beta = velocity = np.zeros(x.shape[1])
    rate = 4 / max(1.0, float((w[:, None] * x * x).sum(axis=0).sum()))
    for k in range(steps):
        ahead = beta + k / (k + 3) * velocity
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty * np.r_[ahead[:-1], 0]
        new = ahead - rate * grad
        velocity, beta = new - beta, new
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, the posterior of the label model and the columns in ``carry``.

    Null and empty texts hold no term and get the score of such texts. A label that is null teaches nothing; of several
    labels of one doc_id each counts. Without any label the seed words vote alone.
    """
    docs = narrow(docs, "doc_id", "text", carry=carry)
    labels = narrow(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    few = [capped(labels.filter(F.col("toxic") == y), F.col("doc_id"), MAX_LABELLED) for y in (0, 1)]
    labelled = settle(docs.join(F.broadcast(few[0].unionByName(few[1])), "doc_id").select("text", "toxic"), "labelled")
    labelled = settle(one_of_each_family(labelled), "families")
    terms = mine_terms(labelled)
    names, of = make_voters(terms)
    n_lexicons = _TIERS * (1 + len(PREFIXES))
    along = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns[2:])
    voted = settle(docs.mapInArrow(_vote([t for t, _ in terms], of.tolist(), n_lexicons), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes string, terms array<int>{along}"), "votes")

    # one row for each pattern of the dozen voters
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    post = label_model([r["votes"] for r in patterns], np.array([r["n"] for r in patterns], float)) if patterns else np.empty(0)
    posterior = docs.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(patterns, post, strict=True)], "votes string, posterior double")
    scored = voted.join(F.broadcast(posterior), "votes")

    fit = scored.filter(~held_out(F.col("doc_id")))
    rows = [r for y in (True, False) for r in capped(fit.filter((F.col("posterior") >= 0.5) == y), F.col("doc_id"), MAX_FIT).select("terms", "posterior").collect()]
    if rows:
        x = np.zeros((len(rows), len(terms) + len(SHARES)), np.float32)
        for i, r in enumerate(rows):
            x[i, r["terms"]] = 1
        y = np.array([r["posterior"] for r in rows])
        beta = fit_linear(x, y, np.where(y >= 0.5, 1 / max(1, (y >= 0.5).sum()), 1 / max(1, (y < 0.5).sum())))
    else:
        beta = np.zeros(len(terms) + len(SHARES) + 1)
    weights = F.array(*[F.lit(float(b)) for b in beta[:-1]])
    logit = F.lit(float(beta[-1])) + F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.get(weights, t))
    score = 1 / (1 + F.exp(-logit))
    out = scored.withColumn("score", score)
    return out.select(*([] if "doc_id" in carry else ["doc_id"]), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "posterior", *carried(carry))

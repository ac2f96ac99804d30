"""Quality and toxicity on held-out documents, and rows that have nothing to score."""

import itertools
import random

import numpy as np
import pytest

from graphloom.llm.quality_classifier import _whole_documents, marginals, quality_scores
from graphloom.llm.shared import table
from graphloom.llm.toxicity import PATTERNS, SHARES, label_model, toxicity


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    from pathlib import Path

    folder = Path(sf_dir).parent / "sf0.01"
    if not folder.is_dir():
        pytest.skip("no larger tables here")
    return table(spark, str(folder), "documents"), table(spark, str(folder), "labels")


def held(scored, labels, column):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", column).collect()
    return [(r["predicted"], r[column]) for r in rows]


def test_quality_of_held_out_documents(larger):
    rows = held(quality_scores(*larger), larger[1], "quality")
    assert sum(p == y for p, y in rows) >= 0.95 * len(rows)


def test_junk_behind_many_good_lines_is_learned(spark):
    """Bad documents that begin like good ones; every line of a chosen document teaches."""
    rng = random.Random(4)
    line = lambda: " ".join(rng.choices("it is the of lines that are in this text and long words to be read".split(), k=rng.randrange(4, 16)))
    junk = lambda: "".join(rng.choices("#$%!|& ", k=rng.randrange(20, 80)))
    texts = [(k, "\n".join([line() for _ in range(405)] + [(line if k % 2 else junk)() for _ in range(500)])) for k in range(24)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id bigint, quality int")
    score = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    assert max(score[k] for k in range(0, 24, 2)) + 0.3 < min(score[k] for k in range(1, 24, 2)), score


def test_whole_documents_are_chosen(spark):
    sample = spark.createDataFrame([(b"a\nb\nc", 0, 1), (b"d\ne", 0, 2), (b"f", 0, 3), (None, 1, 1), (b"g", 1, 2)], "text binary, quality int, key bigint")
    got = {None if r["text"] is None else bytes(r["text"]) for r in _whole_documents(sample, 4).collect()}
    assert got == {b"a\nb\nc", b"d\ne", None, b"g"}


def test_toxicity_of_held_out_documents(larger):
    rows = held(toxicity(*larger), larger[1], "toxic")
    assert sum(p for p, y in rows if not y) <= 0.02 * len(rows)
    assert sum(p for p, y in rows if y) >= 0.6 * sum(y for _, y in rows)


@pytest.mark.parametrize("operator", [quality_scores, toxicity])
def test_odd_rows(spark, operator, odd_docs, no_docs, labels):
    null = spark.createDataFrame([(5, None, None), (None, 1, 1), (20, 1, 0), (21, 0, 1)], "doc_id bigint, quality int, toxic int")
    for some in (null, labels.limit(0)):
        rows = operator(odd_docs, some).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert operator(no_docs, null).collect() == []


@pytest.mark.parametrize("operator", [quality_scores, toxicity])
def test_held_out_labels_are_not_read(spark, operator, documents, labels):
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    scores = lambda some: {r["doc_id"]: round(r["score"], 6) for r in operator(documents, some).collect()}
    assert scores(labels) == scores(flipped)


def test_copies_of_a_voter_count_once():
    """Posteriors of the label model against the true ones, where three of the voters are one weak voter over and over.

    Many more copies than independent voters would take a class for themselves before correlations are estimated.
    """
    rng = np.random.default_rng(4)
    n = 20_000
    y = rng.random(n) < 0.3
    fire = lambda toxic, clean: rng.random(n) < np.where(y, toxic, clean)
    good, weak, seed = [fire(0.7, 0.1) for _ in range(9)], fire(0.5, 0.3), fire(0.6, 0.01)
    lexicons = [*good, *[weak] * 3]
    blank = np.zeros(n, bool)
    voters = np.column_stack([*lexicons, seed, *[blank] * (len(SHARES) + len(PATTERNS))])
    letters = [("".join("+" if v else "." for v in row)) + ("." if row.any() else "-") for row in voters]
    patterns, which, counts = np.unique(letters, return_inverse=True, return_counts=True)
    post = label_model(patterns.tolist(), counts.astype(float))[which]
    odds = np.log(0.3 / 0.7) + sum(np.where(v, np.log(a / b), np.log((1 - a) / (1 - b))) for v, a, b in [*[(g, 0.7, 0.1) for g in good], (weak, 0.5, 0.3), (seed, 0.6, 0.01)])
    right, best = np.mean((post >= 0.5) == y), np.mean((odds >= 0) == y)
    assert right >= best - 0.03


def test_marginals_against_all_paths():
    """Forward and backward sums against an enumeration of every labelling."""
    rng = np.random.default_rng(8)
    counts = np.array([1, 5, 3])
    score, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    good, expected, _ = marginals(score, counts, transition, pairs=True)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        mass = np.array([np.exp(sum(score[at + t] * p[t] for t in range(n)) + sum(transition[p[t], p[t + 1]] for t in range(n - 1))) for p in paths])
        mass /= mass.sum()
        want += [sum(m for m, p in zip(mass, paths, strict=True) if p[t]) for t in range(n)]
        for m, p in zip(mass, paths, strict=True):
            for t in range(n - 1):
                pairs[p[t], p[t + 1]] += m
        at += n
    assert np.allclose(good, want) and np.allclose(expected, pairs)

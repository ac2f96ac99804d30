"""Counts against a brute-force version; outliers against planted ones."""

import random
import re
from collections import Counter

import numpy as np

from graphloom.llm.quality_rules import CONSISTENCY, CUTOFF, DIMENSIONS, FLOORS, STEPS, SUPPORT, quality_rules, text_statistics, vectors


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(df):
    got = sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in quality_rules(df).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)


def test_counts_of_the_whole_table(documents):
    check(documents)


def test_odd_rows(odd_docs):
    check(odd_docs)
    assert all(not r["kept"] for r in quality_rules(odd_docs).collect() if r["base_failed"])


def test_no_rows(no_docs):
    assert quality_rules(no_docs).collect() == []


def test_planted_outliers(spark):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(80, 300)))
    docs = [(k, prose(), "en", "web") for k in range(400)]
    docs += [(1000 + k, prose().replace(" ", "### "), "en", "web") for k in range(20)]
    docs += [(2000 + k, prose().upper(), "en", "web") for k in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sum(got[k] for k in range(400)) >= 396
    assert not any(kept for d, kept in got.items() if d >= 1000)


def reference_mcd(x):
    """Squared distances by concentration steps in numpy, the closest rows told by sorting."""
    def estimate(rows):
        centre = rows.mean(axis=0)
        return centre, CONSISTENCY * np.cov(rows.T, bias=True) + np.diag(np.square(FLOORS))

    def far(fit):
        dev = x - fit[0]
        return np.einsum("ni,ij,nj->n", dev, np.linalg.inv(fit[1]), dev)

    fits = []
    for fit in ((np.median(x, axis=0), np.diag(np.square(FLOORS))), estimate(x)):
        for _ in range(STEPS):
            fit = estimate(x[np.argsort(far(fit), kind="stable")[: int(np.ceil(SUPPORT * len(x)))]])
        fits.append(fit)
    return far(min(fits, key=lambda f: np.linalg.slogdet(f[1])[1]))


def test_distances_against_brute_force(spark):
    rng = random.Random(2)
    letters = "etaoinshrdlucmfwETA#$"
    prose = lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300)))
    docs = [(k, prose() if k % 9 else prose().upper().replace(" ", "## "), "en", "web") for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    rows = [r for r in text_statistics(df).select("doc_id", *[c.alias(n) for n, c in vectors().items()]).orderBy("doc_id").collect()]
    want = reference_mcd(np.array([[r[d] for d in DIMENSIONS] for r in rows]))
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    far = np.array([got[k]["distance2"] for k in range(500)])
    assert np.median(np.abs(far - want) / want) < 0.05
    sure = np.abs(np.log(want / CUTOFF)) > 0.2
    assert sure.mean() > 0.9
    assert all(got[k]["kept"] == (want[k] <= CUTOFF) for k in np.flatnonzero(sure))


def test_main_path_has_no_python(documents):
    plan = quality_rules(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

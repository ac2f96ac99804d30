"""Near-duplicates against all pairs."""

import random
import re

from graphloom.llm.components import components
from graphloom.llm.near_dedup import near_duplicates, posterior


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """(doc_id, n_shingles, component, kept) by comparing every two documents."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in docs if d is not None)


def check(df):
    got = near_duplicates(df).collect()
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == brute(docs)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert len(got) == len(docs)
    return got


def test_whole_table(documents):
    assert any(not r["kept"] for r in check(documents))


def test_chains_copies_and_the_very_threshold(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for family in range(6):
        text = [rng.choice(words) for _ in range(90)]
        for step in range(12):  # each a little further from the first
            docs.append((100 * family + step, " ".join(text)))
            text[rng.randrange(90)] = rng.choice(words)
    base = [f"t{k}" for k in range(16)]  # 12 shingles, of which 12 of 16, then 11 of 17 are shared
    docs += [(1000, " ".join(base)), (1001, " ".join([*base, "a", "b", "c", "d"])), (1002, " ".join([*base[1:], "p", "q", "r", "s", "t"]))]
    docs += [(2000 + k, "Just Three words" if k % 2 else "just three WORDS") for k in range(300)]
    check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7))


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.range(300).selectExpr("id * 7 % 301 AS a", "(id + 1) * 7 % 301 AS b")
    assert {r["component"] for r in components(links).collect()} == {0}


def test_posterior_bound():
    assert posterior(32, 32, 0.75) > 0.99
    assert posterior(0, 32, 0.75) < 1e-15

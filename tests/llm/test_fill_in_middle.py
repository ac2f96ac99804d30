"""Fill-in-middle examples against a regular expression and slices, row by row."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

import graphloom.llm.fill_in_middle as fim
from graphloom.llm.fill_in_middle import OP12_SQL, EliasFano, boundaries, fill_in_middle, op12_columns

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def check(df):
    got = Counter(tuple(r) for r in op12_columns(df).collect())
    assert got == Counter(brute(r["doc_id"], r["text"]) for r in df.collect())
    return got


@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 100))
def test_list_selects_every_value(values, more):
    values = np.array(sorted(values), np.int64)
    held = EliasFano(values, int(values.max(initial=0)) + more)
    assert [held.select(k) for k in range(len(values))] == values.tolist()


@given(st.text())
def test_boundaries_are_those_of_the_pattern(text):
    at = [0]
    for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        at.append(at[-1] + len(unit.encode()))
    assert boundaries(text.encode()).tolist() == at


def test_whole_table(spark, sf_dir, documents):
    got = check(documents)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    want = duckdb.sql(OP12_SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    assert Counter(want) == got


def test_copies_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fim, "SHARE", 16)
    docs = [(k, "the same old text, é and <p>") for k in range(300)] + [(k, f"text {k % 7}") for k in range(300, 400)] + [(k, f"alone {k}") for k in range(400, 420)]
    docs += [(k, "ends in <" if k % 2 else "<S") for k in range(500, 560)] + [(k, "with <M> inside") for k in range(600, 640)]
    check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9))


def test_odd_rows(odd_docs):
    check(odd_docs)
    rows = fill_in_middle(odd_docs, carry=("body", "kept")).collect()
    assert len(rows) == odd_docs.count() and {(r["body"], r["kept"]) for r in rows} == {("y", False)}


def test_no_rows(no_docs):
    assert op12_columns(no_docs).collect() == []


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fim.F, "sha2", lambda c, n: fim.F.lit("ab" * 32))
    with pytest.raises(Exception, match="two texts share"):
        fill_in_middle(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")).collect()

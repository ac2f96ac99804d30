"""Line de-duplication against a brute-force version."""

import hashlib
from collections import defaultdict

from graphloom.llm.line_dedup import line_dedup, op2_columns

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, min_chars=40, min_docs=5):
    where = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None and len(key_of(line)) >= min_chars:
                where[key_of(line)].add(d)
    drop = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or drop.get(key_of(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, **kw):
    got = sorted((tuple(r) for r in op2_columns(df).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    return got


def test_whole_table(documents):
    assert any(r[2] for r in check(documents))


def test_odd_rows(spark, odd_docs):
    line = "A line that stands in MANY documents, long enough to count é"
    more = spark.createDataFrame([(100 + k, f"own {k}\n  {line if k % 2 else line.upper().replace('É', 'é')}\t\n\n{line}") for k in range(6)], "doc_id bigint, text string")
    got = check(odd_docs.select("doc_id", "text").unionByName(more))
    assert sum(r[2] for r in got) == 10


def test_many_repeats_are_joined(documents):
    few = line_dedup(documents.select("doc_id", "text"))
    many = line_dedup(documents.select("doc_id", "text"), max_broadcast_keys=-1)
    assert few.exceptAll(many).isEmpty()


def test_no_rows(no_docs):
    assert op2_columns(no_docs).collect() == []

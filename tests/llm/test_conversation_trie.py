"""The trie of rebuilt conversations against one built from tuples, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import graphloom.llm.conversation_trie as trie
from graphloom.llm.conversation_trie import OP13_SQL, conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    sha = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, sha(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(k[:-1] for k in members if k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words(k)
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def got_of(df):
    return sorted(tuple(r) for r in conversation_trie(df).select(COLUMNS).collect())


@pytest.fixture
def odd_conversations(spark):
    rng = random.Random(4)
    said = [None, "", "hello", "two  words\n", "\x0bthree of them", "é", "é ü"]
    rows = [(rng.choice([0, 1, 3, 7, 19, 20, 21, 39, 45, 59, -3, -20, -21, -41]), rng.choice([None, 0, 1, 2, 3, 3]), rng.choice([None, "", "user", "bot"]), rng.choice(said)) for _ in range(150)]
    rows += [(None, 0, "user", "nobody's")] + [(c, t, "user", f"turn {t}") for c in range(1000, 1300) for t in range(c % 3)] + [(2000 + k, 0, None, None) for k in range(60)]
    return spark.createDataFrame([(*r, 0, b"x") for r in rows], SCHEMA + ", base bigint, node binary").repartition(5)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = got_of(df)
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL.replace('FROM conversations', f"FROM '{sf_dir}/conversations.parquet'")})").fetchall()
    assert sorted(want) == got


def test_odd_rows(odd_conversations, tmp_path):
    rows = [tuple(r)[:4] for r in odd_conversations.collect()]
    want = brute(rows)
    assert got_of(odd_conversations) == want
    pq.write_table(odd_conversations.select("conv_id", "turn", "role", "text").toArrow(), f"{tmp_path}/c.parquet")
    sql = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL.replace('FROM conversations', f"FROM '{tmp_path}/c.parquet'")})").fetchall()
    assert sorted(sql) == want


def test_families_in_parts_and_ids_in_parts(odd_conversations, monkeypatch):
    """The passes over batches, with small bounds: no Spark, as its workers do not see the changed bounds."""
    monkeypatch.setattr(trie, "HELD_NODES", 3)
    rows = [(0, c, bytes([t]) * 4, t) for c in range(6) for t in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["base", "conv_id", "digest", "words"])

    def merged(batches):
        out = {}
        for b in batches:
            for r in b.to_pylist():
                n = out.setdefault(r["node"], [None, 0, 0, [], []])
                n[:3] = [n[0] or r["parent"], r["depth"], max(n[2], r["words"])]
                n[3] += r["members"]
                n[4] += r["ends"]
        return out

    parts = merged(trie._families(iter([batch, batch.slice(0, 0)])))
    monkeypatch.setattr(trie, "HELD_NODES", 1 << 16)
    assert parts == merged(trie._families(iter([batch])))
    monkeypatch.setattr(trie, "PART_BYTES", 7)
    ids = [(b"a", k) for k in range(-3, 30)] + [(b"b", 5)] + [(b"c", k) for k in range(100, 200)]
    joined = [r for b in trie._parts(iter([pa.RecordBatch.from_arrays([pa.array([n for n, _ in ids]), pa.array([i for _, i in ids])], ["node", "id"])])) for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert len(joined) > 3
    batches = [pa.RecordBatch.from_arrays([pa.array([n for n, _ in joined[k : k + 4]]), pa.array([p for _, p in joined[k : k + 4]])], ["node", "part"]) for k in range(0, len(joined), 4)]
    got = {r["node"]: r["ends_sha256"] for b in trie._hashes(iter(batches)) for r in b.to_pylist()}
    assert got == {n: hashlib.sha256(",".join(str(i) for m, i in ids if m == n).encode()).hexdigest() for n in (b"a", b"b", b"c")}


def test_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(trie, "HOT_CHILDREN", 20)
    rows = [(c, 0, "system", f"start {c % 2}") for c in range(400)] + [(c, 1, "user", f"own {c}") for c in range(400)]
    assert got_of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_no_rows(spark):
    assert got_of(spark.createDataFrame([], SCHEMA)) == []
    assert got_of(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []

"""The trie of the turns that rebuilt conversations begin with, merged family by family first.

Conversations meet by base id, the base's own turns first, as lean rows: a digest of role and text, and the words of the text.
One pass over the sorted rows rebuilds each conversation and combines a family's nodes in a small trie; only these combined
nodes are shuffled by node and merged. A node belongs to its smallest member. Whatever conversation owns a node owns all nodes
below it on its path, so sums over subtrees need no walk level by level: each conversation totals what it owns, families add
up the totals of a node's members, and a running sum along the owner takes off what lies above the node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import narrow, settle

#: Ids of a family: those with the same quotient by this.
FAMILY = 20
#: A conversation takes fewer turns than this from its base.
MOST_LENT = 4
#: The node without turns.
ROOT = bytes(16)
#: Nodes of a family that a task combines at a time; a family with more of them is handed on in parts, which merge like families.
HELD_NODES = 1 << 16
#: Rows of a batch that is handed on.
BATCH_ROWS = 1 << 13
#: Bytes of comma-joined ids that are written as one part.
PART_BYTES = 1 << 16
#: A parent with more children than this, or than one in ``MOST_HOT`` of all nodes, is broadcast to them: ``MOST_HOT`` at most.
HOT_CHILDREN, MOST_HOT = 100, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def lent(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(b"%d" % conv_id) % MOST_LENT


class _Family:
    """The nodes of one family: parent, depth, words of the last text, members, members that end here."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.lead: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, tuple] = {}
        self.conv: int | None = None
        self.at, self.depth, self.own = ROOT, 0, 0

    def step(self, digest: bytes, words: int) -> None:
        parent, self.at = self.at, hashlib.blake2b(self.at + digest, digest_size=16).digest()
        self.depth += 1
        self.nodes.setdefault(self.at, (parent, self.depth, words, [], []))[3].append(self.conv)

    def begin(self, base: int, conv: int) -> None:
        self.base, self.conv, self.at, self.depth, self.own = base, conv, ROOT, 0, 0
        self.nodes.setdefault(ROOT, (None, 0, 0, [], []))[3].append(conv)
        if conv != base:
            for turn in self.lead[: lent(conv)]:
                self.step(*turn)

    def turn(self, digest: bytes, words: int) -> None:
        """The next own turn of the conversation: the base's are all kept, of others those after the ones it takes from its base."""
        self.own += 1
        if self.conv == self.base and self.own < MOST_LENT:
            self.lead.append((digest, words))
        if self.conv == self.base or self.own > lent(self.conv):
            self.step(digest, words)

    def end(self) -> None:
        if self.conv is not None:
            depth = self.depth
            self.nodes.setdefault(self.at, (None, depth, 0, [], []))[4].append(self.conv)


def _rows(base: int, nodes: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
    items = list(nodes.items())
    for k in range(0, len(items), BATCH_ROWS):
        part = items[k : k + BATCH_ROWS]
        parent, depth, words, members, ends = zip(*(v for _, v in part), strict=True)
        arrays = [pa.array([base] * len(part), pa.int64()), pa.array([n for n, _ in part], pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int64()), pa.array(words, pa.int64()), pa.array(members, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["base", "node", "parent", "depth", "words", "members", "ends"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combined nodes of each family, from (base, conv_id, digest, words) sorted by base, the base's conversation first."""
    family = _Family()
    for batch in batches:
        for base, conv, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != family.conv:
                family.end()
                if base != family.base:
                    if family.nodes:
                        yield from _rows(family.base, family.nodes)
                    family = _Family()
                family.begin(base, conv)
            family.turn(digest, words)
            if len(family.nodes) >= HELD_NODES:
                # what is known of the place reached goes along, as its ending may still be noted
                yield from _rows(family.base, family.nodes)
                family.nodes = {}
    family.end()
    if family.nodes:
        yield from _rows(family.base, family.nodes)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined parts of the sorted (node, id)."""
    node, ids, size, held = None, [], 0, 0
    out: list[tuple[bytes, int, bytes]] = []

    def close() -> None:
        if ids:
            out.append((node, ids[0], b",".join(b"%d" % i for i in ids)))

    def batch_of() -> pa.RecordBatch:
        n, first, part = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), pa.array(first, pa.int64()), pa.array(part, pa.binary())], ["node", "first", "part"])

    for batch in batches:
        for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node or size >= PART_BYTES:
                close()
                node, ids, size, held = n, [], 0, held + size
                if len(out) >= BATCH_ROWS or held >= 16 * PART_BYTES:
                    yield batch_of()
                    out, held = [], 0
            ids.append(i)
            size += len(str(i)) + 1
    close()
    if out:
        yield batch_of()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined parts of each node, from (node, part) in order."""
    node, running = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n == node:
                running.update(b",")
            else:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = n, hashlib.sha256()
            running.update(part)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """(base, node, parent, depth, words, members, ends) of each family's trie; families need not be merged to be searched."""
    rows = narrow(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    lean = rows.select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ordered = lean.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return ordered.select("base", "conv_id", "digest", "words").mapInArrow(_families, "base bigint, node binary, parent binary, depth bigint, words bigint, members array<bigint>, ends array<bigint>")


def _ends(families: DataFrame) -> DataFrame:
    """(node, ends_sha256): a node's ids are joined in parts wherever range partitions cut them, then the parts are hashed in order."""
    ids = families.select("node", F.explode("ends").alias("id")).repartitionByRange("node", "id").sortWithinPartitions("node", "id")
    parts = ids.mapInArrow(_parts, "node binary, first bigint, part binary")
    return parts.repartition("node").sortWithinPartitions("node", "first").select("node", "part").mapInArrow(_hashes, "node binary, ends_sha256 string")


def _parents(tops: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(node, parent_conv_id) of the nodes whose parent has another owner; parents of very many children are broadcast."""
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    least = max(HOT_CHILDREN, ceil(rows / MOST_HOT))
    hot = F.broadcast(parents.filter(F.col("n_children") > least).drop("n_children"))
    found = tops.join(hot, "parent").select("node", "parent_conv_id")
    rest = tops.join(hot, "parent", "left_anti").join(parents.filter(F.col("n_children") <= least), "parent").select("node", "parent_conv_id")
    return found.unionByName(rest)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first; those of one number by the SHA-256 of role and text, so that repeated rows are turns of their
    own in a settled order. Rows without conv_id belong to no conversation. Without any conversation there is no node, not even
    the root. Negative ids count towards zero: -5 belongs to base 0. Sequences are told apart by digests of 128 bits.
    """
    families = settle(family_nodes(conversations), "families")
    merged = families.groupBy("node").agg(F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("parent").alias("parent"))
    merged = settle(merged, "merged")
    children = merged.filter("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = settle(merged.join(children, "node", "left").select("node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved")), "nodes")

    conv = F.col("conv_id")
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves"))
    totals = owned.groupBy((conv - conv % FAMILY).alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("saved", "leaves")))).alias("of"))
    add = lambda what: F.aggregate(F.col("members"), F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(F.col("of")[m][what], F.lit(0).cast("long")))
    sums = families.join(totals, "base", "left").select("node", add("saved").alias("s"), add("leaves").alias("l")).groupBy("node").agg(F.sum("s").alias("total"), F.sum("l").alias("n_leaves"))

    along = W.partitionBy("conv_id").orderBy("depth")
    placed = nodes.withColumns({"above": F.coalesce(F.sum("saved").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "own": F.lag("depth").over(along).isNotNull()})
    placed = settle(placed, "placed")
    lifted = _parents(placed.filter("NOT own AND depth > 0").select("node", "parent"), nodes, nodes.count())
    out = placed.join(sums, "node").join(lifted, "node", "left").join(_ends(families), "node", "left")
    return out.select("conv_id", "depth", F.when(F.col("own"), conv).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: CRC-32 of a decimal id, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(conv_id::VARCHAR)), lambda i: ord(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"

OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns, {_CRC} % 4 AS h FROM turns GROUP BY conv_id),
paths AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS p
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (
  SELECT conv_id, depth, len(p) AS n, CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS words,
    min(conv_id) OVER (PARTITION BY depth, list_slice(p, 1, depth)) AS owner
  FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT owner, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
  FROM steps GROUP BY owner, depth),
parents AS (
  SELECT n.*, s.owner AS parent FROM nodes n LEFT JOIN steps s ON s.conv_id = n.owner AND s.depth = n.depth - 1),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
known AS (SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parents p LEFT JOIN children c ON c.parent = p.owner AND c.depth = p.depth),
below AS (
  SELECT s.owner, s.depth, sum(k.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM known k JOIN steps s ON s.conv_id = k.owner AND s.depth <= k.depth GROUP BY ALL)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM known JOIN below USING (owner, depth)
"""

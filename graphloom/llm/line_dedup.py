"""Line de-duplication with two Bloom filters.

1. Each task codes the keys of its lines into cells of a once-seen filter whose segments are merged by key range:
   a key that finds its bits set already has been seen elsewhere and goes into the twice-seen filter.
2. Only lines in the twice-seen filter - suspected repeats - are shuffled, as digests, and counted exactly.
3. Confirmed repeats are dropped everywhere but in the document with the largest id.

The once-seen filter is never gathered: it grows with the lines and lives in pieces of 64 KiB. The twice-seen filter is
broadcast; its size follows the number of suspected keys up to ``MAX_FILTER_BYTES``. Beyond, it only suspects more
lines; the exact count decides alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import WORD_SPACE_CHARS, drop_settled, narrow, settle

MIN_CHARS = 40
MIN_DOCS = 5
#: Words of 64 bits in a segment of a filter.
SEGMENT_WORDS = 8192
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 << 20
#: Confirmed repeats that are handed to every task at most; more are joined.
MAX_BROADCAST_KEYS = 200_000
#: Hashes that a task holds before it emits its part of the filter.
TASK_KEYS = 1_000_000

_SPACE = WORD_SPACE_CHARS.encode()


def _keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The key of each line; None for one that is too short to count."""
    out = []
    for line in lines:
        key = line.strip(_SPACE)
        n = len(key)
        out.append(key.lower() if n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars) else None)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cells(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and cell of each hash: a cell names a word (13 bits) and three bits in it (6 each)."""
    h = _mix(h)
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32), (h & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def _again(segment: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The identity of a cell as a hash, under which it enters the twice-seen filter."""
    return (segment.astype(np.uint64) << np.uint64(32)) | cell.astype(np.uint64)


def _word_mask(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, one, low = cell.astype(np.uint64), np.uint64(1), np.uint64(63)
    mask = (one << (c & low)) | (one << ((c >> np.uint64(6)) & low)) | (one << ((c >> np.uint64(12)) & low))
    return (c >> np.uint64(18)).astype(np.int64), mask


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield doc_id, text.as_py() or b""


def _parts(segments: int, min_chars: int):
    """Per task and segment: cells of the keys of one document of the task, and of those of several."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        seg, cell = _cells(keys, segments)
        order = np.argsort(seg, kind="stable")
        seg, cell, often = seg[order], cell[order], counts[order] > 1
        edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.empty(0, np.int64)
        ends = np.r_[edges[1:], len(seg)] if len(seg) else edges
        rows = [(int(seg[a]), np.unique(cell[a:b]).tobytes(), np.unique(cell[a:b][often[a:b]]).tobytes()) for a, b in zip(edges, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, text in _texts(batch):
                if doc_id is None:
                    continue
                keys = {k for k in _keys(text.split(b"\n"), min_chars) if k is not None}
                held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                n += len(keys)
                if n >= TASK_KEYS:
                    yield emit(held)
                    held, n = [], 0
        yield emit(held)

    return run


def _merge(part: pa.Table) -> pa.Table:
    """One segment of the once-seen filter, built task by task; out come the cells that were seen twice."""
    seen, suspected = np.zeros(SEGMENT_WORDS, np.uint64), []
    for once, twice in zip(part.column("once"), part.column("twice"), strict=True):
        cell = np.frombuffer(once.as_py(), np.uint32)
        word, mask = _word_mask(cell)
        suspected += [cell[(seen[word] & mask) == mask], np.frombuffer(twice.as_py(), np.uint32)]
        np.bitwise_or.at(seen, word, mask)
    cells = np.unique(np.concatenate(suspected))
    return pa.table({"segment": pa.array([part.column("segment")[0].as_py()], pa.int32()), "n": pa.array([len(cells)], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())})


def _regions(segments: int):
    """The suspected cells, dealt out to the segments of the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_seg, out_cells = [], []
            for segment, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cell = np.frombuffer(cells, np.uint32)
                seg, code = _cells(_again(np.full(len(cell), segment), cell), segments)
                for s in np.unique(seg):
                    out_seg.append(int(s))
                    out_cells.append(code[seg == s].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_seg, pa.int32()), pa.array(out_cells, pa.binary())], ["region", "cells"])

    return run


def _bits(part: pa.Table) -> pa.Table:
    seen = np.zeros(SEGMENT_WORDS, np.uint64)
    for cells in part.column("cells"):
        word, mask = _word_mask(np.frombuffer(cells.as_py(), np.uint32))
        np.bitwise_or.at(seen, word, mask)
    return pa.table({"region": pa.array([part.column("region")[0].as_py()], pa.int32()), "bits": pa.array([seen.tobytes()], pa.binary())})


class TwiceSeen:
    """The twice-seen filter as every task holds it. No key of two documents is missed; few others are found."""

    def __init__(self, once_segments: int, regions: int, bits: np.ndarray) -> None:
        self.once_segments, self.regions, self.bits = once_segments, regions, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        seg, code = _cells(_again(*_cells(hashes, self.once_segments)), self.regions)
        word, mask = _word_mask(code)
        return (self.bits[seg.astype(np.int64) * SEGMENT_WORDS + word] & mask) == mask

    def suspects(self, keys: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
        """Place and digest of the suspected keys among the keys of a document."""
        at = [i for i, k in enumerate(keys) if k is not None]
        if not at:
            return
        found = self.holds(np.fromiter((xxhash.xxh3_64_intdigest(keys[i]) for i in at), np.uint64, len(at)))
        for j in np.flatnonzero(found):
            yield at[j], hashlib.blake2b(keys[at[j]], digest_size=16).digest()


def twice_seen(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[int, int, np.ndarray]:
    """Build both filters over ``docs`` (doc_id, body); what ``TwiceSeen`` takes."""
    lines = docs.select(F.sum(F.least(F.length("body") / min_chars, F.length("body") - F.length(F.translate(F.col("body").cast("string"), "\n", "")) + 1)).cast("long")).first()[0] or 0
    segments = max(1, -(-lines * BITS_PER_KEY // (SEGMENT_WORDS * 64)))
    parts = docs.mapInArrow(_parts(segments, min_chars), "segment int, once binary, twice binary")
    merged = settle(parts.groupBy("segment").applyInArrow(_merge, "segment int, n bigint, cells binary"), "bloom")
    n = merged.agg(F.sum("n")).first()[0] or 0
    regions = min(max(1, -(-n * BITS_PER_KEY // (SEGMENT_WORDS * 64))), MAX_FILTER_BYTES // (SEGMENT_WORDS * 8))
    rows = merged.select("segment", "cells").mapInArrow(_regions(regions), "region int, cells binary").groupBy("region").applyInArrow(_bits, "region int, bits binary").collect()
    drop_settled(merged)
    bits = np.zeros(regions * SEGMENT_WORDS, np.uint64)
    for row in rows:
        bits[row["region"] * SEGMENT_WORDS :][:SEGMENT_WORDS] = np.frombuffer(row["bits"], np.uint64)
    return int(segments), int(regions), bits


def _suspected(filters, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = TwiceSeen(*filters.value)
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in _texts(batch):
                if doc_id is not None:
                    found = {d for _, d in twice.suspects(_keys(text.split(b"\n"), min_chars))}
                    ids += [doc_id] * len(found)
                    digests += found
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64())], ["digest", "doc_id"])

    return run


def _kept(filters, keepers, min_chars: int):
    """Texts without their dropped lines. keepers: document by digest; without, the rows bring the digests to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = TwiceSeen(*filters.value)
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            drops = batch.column(2).to_pylist() if keepers is None else [()] * batch.num_rows
            for (doc_id, text), drop in zip(_texts(batch), drops, strict=True):
                lines = text.split(b"\n")
                gone = set()
                if doc_id is not None and (drop or keepers is not None):
                    for i, d in twice.suspects(_keys(lines, min_chars)):
                        if d in drop if keepers is None else keepers.value.get(d, doc_id) != doc_id:
                            gone.add(i)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()), *batch.columns[3:]], ["doc_id", "n_lines", "n_dropped", "kept", *batch.schema.names[3:]])

    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, text (without the dropped lines) and the columns in ``carry``.

    A line repeats if its key stands in ``min_docs`` documents; rows with the same doc_id are one document. It stays in the
    document with the largest doc_id, every time it stands there. A null or empty text is one empty line. A row with null doc_id
    is no document: it counts for nothing and stays whole. Keys are told apart by 128-bit digests.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"), *[F.col(f"`{c}`") for c in carry])
    pairs = body.select("doc_id", "body")
    filters = spark.sparkContext.broadcast(twice_seen(pairs, min_chars))
    found = pairs.mapInArrow(_suspected(filters, min_chars), "digest binary, doc_id bigint").distinct()
    repeats = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    repeats = settle(repeats, "repeats")
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept binary" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    if repeats.count() <= max_broadcast_keys:
        keepers = spark.sparkContext.broadcast({bytes(r["digest"]): r["keeper"] for r in repeats.toLocalIterator()})
        out = body.select("doc_id", "body", F.lit(None).cast("string").alias("none"), *carry).mapInArrow(_kept(filters, keepers, min_chars), schema)
    else:
        drops = found.join(repeats, "digest").filter(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_list("digest").alias("drops"))
        out = body.join(drops, "doc_id", "left").select("doc_id", "body", "drops", *carry).mapInArrow(_kept(filters, None, min_chars), schema)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])


def op2_columns(docs: DataFrame) -> DataFrame:
    return line_dedup(narrow(docs, "doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in SQL.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN repeats r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

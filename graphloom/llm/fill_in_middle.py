"""Fill-in-middle examples through an index of distinct texts.

Identical texts are grouped by their whole content, copies first within each task, then across tasks by SHA-256 and content. The
distinct texts are joined back to the ids of their documents, so that a text crosses the network once however many documents
hold it; a text of very many documents is dealt out to as many tasks as those fill. Where a text meets its documents, the list
of its token boundaries is built once as an Elias-Fano list, and each document selects its two seeded cuts from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import carried, handed_out, narrow, settle

#: What marks prefix, suffix and middle, and the shares in 100 of plain texts and of suffix-first ones.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = 1
#: Documents of one text that a task handles at most; more are dealt out.
SHARE = 1024
#: Hot texts (their hashes and counts) that are broadcast at most; there is one for SHARE documents at most. More are joined.
MAX_HOT = 200_000
#: Bytes of texts that a task remembers to find copies before the shuffle.
REMEMBERED = 32 << 20
#: Bytes of texts in a batch that is handed on.
BATCH_BYTES = 8 << 20


class EliasFano:
    """An increasing list of integers in about 2 + log2(largest / length) bits each, with selection of the k-th."""

    def __init__(self, values: np.ndarray, largest: int) -> None:
        self.low_bits = max(0, (max(largest, 1) // max(len(values), 1)).bit_length() - 1)
        high = np.zeros((largest >> self.low_bits) + len(values) + 1, bool)
        high[(values >> self.low_bits) + np.arange(len(values))] = True
        words = np.packbits(high, bitorder="little")
        self.high = np.concatenate([words, np.zeros(-len(words) % 8, np.uint8)]).view("<u8")
        self.low = np.packbits((values[:, None] >> np.arange(self.low_bits)) & 1, bitorder="little") if self.low_bits else np.empty(0, np.uint8)
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.ones, k, side="right"))
        before = int(self.ones[word - 1]) if word else 0
        bits = np.flatnonzero(np.unpackbits(self.high[word : word + 1].view(np.uint8), bitorder="little"))
        upper = 64 * word + int(bits[k - before]) - k
        at = k * self.low_bits
        window = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return upper << self.low_bits | (window >> (at & 7)) & ((1 << self.low_bits) - 1)


def boundaries(text: bytes) -> np.ndarray:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text begin, and its length: byte offsets."""
    b = np.frombuffer(text, np.uint8)
    letter = ((b | 32) - np.uint8(97)) < 26
    start = (b & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(start), len(b))


def _points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


class Indexed:
    """A distinct text with its boundary list."""

    def __init__(self, text: bytes) -> None:
        at = boundaries(text)
        self.text, self.n = text, len(at) - 1
        self.list = EliasFano(at, len(text))
        self.whole = not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))

    def example(self, doc_id: int | None) -> tuple[str, int | None, int | None, bytes]:
        """Form, code points of prefix and middle, and the example of a document that holds this text."""
        seed = hashlib.sha256(b"%d:%s" % (SEED, b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
        h1, h2, h3, h4 = (int(seed[8 * k : 8 * k + 8], 16) for k in range(4))
        if self.whole or h3 % 100 >= PLAIN_FROM:
            return "plain", None, None, self.text
        first, second = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        a, b = self.list.select(first), self.list.select(second)
        prefix, middle, suffix = self.text[:a], self.text[a:b], self.text[b:]
        if h4 % 100 < SUFFIX_FIRST_BELOW:
            return "spm", _points(prefix), _points(middle), b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return "psm", _points(prefix), _points(middle), b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, body) without the copies of texts that the task still remembers."""
    seen: set[bytes] = set()
    held = 0
    for batch in batches:
        new = []
        for i, body in enumerate(batch.column(1)):
            text = body.as_py()
            if text not in seen:
                new.append(i)
                seen.add(text)
                held += len(text)
                if held > REMEMBERED:
                    seen, held = set(), 0
        yield batch.take(pa.array(new, pa.int64()))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of (fp, body, doc_id, ...), whose rows of one text follow each other."""
    fp, text = None, None
    for batch in batches:
        begin, size, made = 0, 0, []
        for i, (f, body, doc_id) in enumerate(zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True)):
            if (f := f.as_py()) != fp:
                fp, text = f, Indexed(body.as_py())
            elif body.as_py() != text.text:
                raise ValueError(f"two texts share the SHA-256 {fp.hex()}")
            made.append((text.n, *text.example(doc_id)))
            size += len(text.text)
            if size >= BATCH_BYTES:
                yield _batch(batch, begin, made)
                begin, size, made = i + 1, 0, []
        if made:
            yield _batch(batch, begin, made)


def _batch(batch: pa.RecordBatch, begin: int, made: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*made, strict=True)
    rest = [c.slice(begin, len(made)) for c in batch.columns[2:]]
    columns = [rest[0], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()), *rest[1:]]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[3:]])


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(fp, body) of every distinct text, dealt out by fp: copies are dropped in each task before the shuffle, then by content."""
    return keyed.select("fp", "body").mapInArrow(_first_of_task, "fp binary, body binary").repartition("fp").distinct()


def fill_in_middle(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars, output (text) and the columns in ``carry``.

    A null text is empty; an empty text and one that holds a mark stay plain. A null doc_id seeds its cuts with the empty string.
    Rows of one doc_id are rows of their own, each cut in its own text. Two texts with one SHA-256 would be an error.
    """
    docs = narrow(docs, "doc_id", "text", carry=carry)
    along = docs.columns[2:]
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("fp"), *along)
    members = keyed.select("fp", "doc_id", *along)

    hot = settle(members.groupBy("fp").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > SHARE).select("fp", F.ceil(F.col("held") / SHARE).cast("int").alias("slots")), "hot-texts")
    few = hot.count()
    joined = [(distinct_texts(keyed), members, ["fp"])]
    if few:
        known = handed_out(hot, few, MAX_HOT)
        only = known.select("fp")
        cold = [df.join(only, "fp", "left_anti") for df in (keyed, members)]
        texts = distinct_texts(keyed.join(only, "fp", "left_semi")).join(known, "fp").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
        dealt = members.join(known, "fp").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int")).drop("slots")
        joined = [(distinct_texts(cold[0]), cold[1], ["fp"]), (texts, dealt, ["fp", "slot"])]
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in along)
    parts = [t.hint("merge").join(m, by).sortWithinPartitions("fp").select("fp", "body", "doc_id", *along).mapInArrow(_examples, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary" + kinds) for t, m, by in joined]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"), *carried(carry))


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from; its marks are the first of their kind, as no marked text is cut."""
    prefix, suffix, middle = (m.decode() for m in (PREFIX, SUFFIX, MIDDLE))
    piece = lambda after, before: F.substring_index(F.substring(output, len(after) + 1, 2**31 - 1), before, 1)
    rest = lambda mark: F.substring(output, F.locate(mark, output) + len(mark), F.length(output))
    first = F.concat(piece(prefix, suffix), rest(middle), F.substring_index(rest(suffix), middle, 1))
    last = F.concat(F.substring_index(rest(prefix), middle, 1), rest(middle), piece(suffix, prefix))
    return F.when(form == "psm", first).when(form == "spm", last).otherwise(output)


def op12_columns(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
seeds AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM units),
cut AS (
  SELECT doc_id, t, n, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS p, array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m,
    array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM seeds)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM cut
"""

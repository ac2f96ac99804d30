"""Concatenate and cut: documents, tokenised and joined into one stream, are cut into sequences of fixed length.

Pass one tokenises every text once and notes where it starts among the tokens of its partition; the ids are written to the
shared folder. Prefix sums over the partitions' totals give each document its place in the stream. Pass two cuts at the
multiples of the length; a document that crosses one gives a record on either side.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import narrow, settle

LENGTH = 2048
#: The id that ends a document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of text whose ids a task remembers, and the longest of them.
KNOWN_PIECES, KNOWN_CHARS = 700_000, 40
#: What marks the last token of a word.
WORD_END = "</w>"
#: How the tokenizer splits lower-case text, and what sends a text to it whole.
_PIECE = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|[^\w\s]+")
_PIECE_OR_LINE = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+")
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\u03a3")


def _young() -> np.ndarray:
    """The code points that one library may take for a letter or digit and another, of an older or younger standard, not."""
    kind = lambda c: c[0] if c[0] in "LN" else ""
    out = np.zeros(0x110000, bool)
    for i in range(128, len(out)):
        now = unicodedata.category(chr(i))
        out[i] = now == "Cn" or kind(now) and kind(now) != kind(unicodedata.ucd_3_2_0.category(chr(i)))
    return out


#: Bytes of ids in a batch that is handed on.
BATCH_BYTES = 8 << 20


def load_tokenizer(name: str):
    """A tokenizer by its path, or by its file name among the public ones of the machine that runs this."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


class WordEncoder:
    """Ids of whole texts as little-endian 16 or 32-bit numbers, by a memory of their pieces.

    For tokenizers that fold case, split texts as ``PIECE`` does and mark the end of a word. Texts on which libraries may differ - special
    tokens, rare separators, characters to be composed, letters of late editions of the standard - are encoded whole.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.young = _young()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 65536 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith(WORD_END)
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces; those of letters alone end with their one end-of-word token, so many are encoded at once."""
        words = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        out = dict(zip(rest, self._encode(rest), strict=True))
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some):
                raw, wide = ids.tobytes(), self.kind.itemsize
                out.update(zip(some, (raw[wide * a : wide * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
            else:
                out.update(zip(some, self._encode(some), strict=True))
        return out

    def _plain(self, text: str) -> bool:
        return unicodedata.is_normalized("NFC", text) and not self.young[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

    def texts(self, texts: list[str]) -> list[bytes]:
        lower = [t.lower() for t in texts]
        # pieces are composed once more when they are encoded, so the text in lower case must stay as it is under composition too
        odd = [any(c in t for c in _ODD) or not (t.isascii() or self._plain(t) and self._plain(x)) for t, x in zip(texts, lower, strict=True)]
        pieces = [[] if o else (_PIECE_OR_LINE if "_" in t else _PIECE).findall(t) for t, o in zip(lower, odd, strict=True)]
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.clear()
        new = set(chain.from_iterable(pieces)).difference(known)
        once = {}
        for piece, ids in self._learn(new).items():
            (known if len(piece) <= KNOWN_CHARS else once)[piece] = ids
        at = known.__getitem__
        if once:
            return [self._encode([t])[0] if o else b"".join([known[x] if x in known else once[x] for x in p]) for t, o, p in zip(texts, odd, pieces, strict=True)]
        return [self._encode([t])[0] if o else b"".join(map(at, p)) for t, o, p in zip(texts, odd, pieces, strict=True)]


def worker_encoder(name: str) -> WordEncoder:
    """The encoder of this Python worker, which serves one task after another and keeps what it has learned."""
    kept = sys.modules.setdefault("packing_worker", ModuleType("packing_worker"))
    if name not in vars(kept):
        setattr(kept, name, WordEncoder(load_tokenizer(name)))
    return getattr(kept, name)


def _tokenise(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = worker_encoder(name), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            ids, at, size = [], 0, 0
            texts = batch.column(1).to_pylist()
            for upto in range(len(texts)):
                size += len(texts[upto] or "")
                if size < BATCH_BYTES // 4 and upto < len(texts) - 1:
                    continue
                ids = [x + end for x in encoder.texts([t or "" for t in texts[at : upto + 1]])]
                counts = np.array([len(x) // encoder.kind.itemsize for x in ids], np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : upto + 1], pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "part", "local", "doc_tokens", "ids"])
                at, size = upto + 1, 0

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, counts = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            pieces = (first + counts - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(first)), pieces)
            sequence = first[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(first[row], sequence * length)
            stop = np.minimum(first[row] + counts[row], (sequence + 1) * length)
            crc = np.zeros(len(row), np.int64)
            ids, held = batch.column(3), None
            for i, (r, a, b) in enumerate(zip(row.tolist(), (begin - first[row]).tolist(), (stop - first[row]).tolist(), strict=True)):
                if held != r:
                    raw = ids[r].as_buffer()
                    held, raw = r, memoryview(np.frombuffer(raw, "<u2" if raw.size == 2 * counts[r] else "<u4").astype("<u4"))
                crc[i] = zlib.crc32(raw[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(begin - first[row]), pa.array(stop - begin), pa.array(crc), pa.array(counts[row]), pa.array(sequence), pa.array(begin - sequence * length)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is packed, repeated ones too; a null or empty text is the end id alone, a null doc_id stays null.
    All sequences are full but the last.
    """
    docs = narrow(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = settle(docs.mapInArrow(_tokenise(tokenizer, end_id), f"doc_id {kind}, part int, local bigint, doc_tokens bigint, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))  # a row a partition
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("local")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(length), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

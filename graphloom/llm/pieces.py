"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model: the normaliser (its rewriting rules, white space to its mark, a mark before the text), a trie with an arc of
weight -score for each piece, and byte arcs for characters that no piece is. Composed with an input the arcs are a lattice over the
places of the text; its encoding is the shortest path in the tropical semiring.

A BPE model takes one more acceptor. Its merges end in a sequence of pieces exactly if they end, for every two neighbours, in just these
two from their joined text; so the acceptor's state is the last piece and it passes only such neighbours. By the same rule one piece
alone can end at each place, so a place of the composition needs one state.

No piece has a mark behind another character, so no arc crosses from one word to the next: words are composed apart and, the
arcs being flat arrays, thousands at a time. The time of a text, or of a run of any one character, grows in proportion to its length.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import narrow

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a task remembers, and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 400_000, 40
#: Characters of words that are composed at a time; a longer word is relaxed arc by arc, in windows of as many.
WINDOW, LONG = 1 << 17, 64
#: Slots for what the acceptor has found out about two pieces.
SLOTS = 1 << 20
#: Characters of text that are encoded at a time.
SLICE = 2 << 20
#: Numbers of characters that are not pieces follow those of the pieces.
POINTS = 0x110000


class Normaliser:
    """The rules of a model's normaliser: the longest rule at each place, spaces as the model wants them, marks for spaces."""

    def __init__(self, spec) -> None:
        self.rules = compiled_rules(spec.precompiled_charsmap)
        self.first = re.compile("[" + "".join(map(re.escape, sorted({s[0] for s in self.rules}))) + "]") if self.rules else None
        self.longest = max(map(len, self.rules), default=0)
        self.squeeze, self.prefix = spec.remove_extra_whitespaces, SPACE if spec.add_dummy_prefix else ""

    def rewritten(self, text: str) -> str:
        out, at = [], 0
        while m := self.first.search(text, at):
            out.append(text[at : m.start()])
            for n in range(self.longest, 0, -1):
                if (to := self.rules.get(text[m.start() : m.start() + n])) is not None and m.start() + n <= len(text):
                    out.append(to)
                    at = m.start() + n
                    break
            else:
                out.append(m[0])
                at = m.end()
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        if self.first:
            text = self.rewritten(text)
        text = text.replace(" ", SPACE)
        if self.squeeze:
            text = re.sub(f"{SPACE}+", SPACE, text.strip(SPACE))
        return self.prefix + text if text else ""


def compiled_rules(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules of a charsmap: a double-array trie of their left sides, then the right sides, each ended by a zero byte."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    unit, sides = np.frombuffer(charsmap[4 : 4 + size], "<u4"), charsmap[4 + size :]
    step = lambda u: int((u >> 10) << ((u & 512) >> 6))
    labels, rules, open_ = np.arange(1, 256), {}, [(step(int(unit[0])), b"")]
    while open_:
        node, left = open_.pop()
        to = node ^ labels
        to = to[to < len(unit)]
        for at in to[(unit[to] & 0x800000FF) == (node ^ to)].tolist():
            u, side = int(unit[at]), left + bytes([node ^ at])
            below = at ^ step(u)
            if u & 256:
                start = int(unit[below]) & 0x7FFFFFFF
                rules[side] = sides[start : sides.index(b"\0", start)]
            open_.append((below, side))
    return {a.decode(): b.decode() for a, b in rules.items()}


def merged(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging neighbours, the best rank and leftmost first, ends with, and the two merged last. For pieces and pairs of them."""
    out, two = list(text), None
    while len(out) > 1:
        best, at = min((rank.get(a + b, len(rank)), k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)))
        if best == len(rank):
            break
        two = (out[at], out[at + 1])
        out[at : at + 2] = ["".join(two)]
    return out, two


class Transducer:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type not in (1, 2) or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are compiled")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that mark the beginning of words are compiled")
        self.normalised = Normaliser(proto.normalizer_spec)
        self.merges = proto.trainer_spec.model_type == 2
        self.names = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.outputs = [byte_of.get(i, b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(proto.pieces)]
        pieces = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == 1}
        self.weight = np.array([-p.score for p in proto.pieces])
        self.byte_weight = 10 - min(self.score.values(), default=0)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces.values())
        self.word = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.unreachable: set[int] = set()
        if self.merges:
            self._compile_merges()
        self._compile_trie({i: p for i, p in pieces.items() if i not in self.unreachable})
        self.known: dict[str, bytes] = {}
        self.slot_key, self.slot_passes = np.full(SLOTS, -1), np.zeros(SLOTS, bool)

    def _compile_trie(self, pieces: dict[int, str]) -> None:
        """Arcs as sorted keys (node, symbol) with the nodes they lead to; ``ends`` is the piece that a node completes."""
        alphabet = sorted({c for p in pieces.values() for c in p})
        self.symbol = np.full(POINTS, -1, np.int32)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        number = {c: i for i, c in enumerate(alphabet)}
        arcs: dict[int, int] = {}
        ends = {}
        for i, p in pieces.items():
            node = 0
            for c in p:
                node = arcs.setdefault(node * len(alphabet) + number[c], len(arcs) + 1)
            ends[node] = i
        keys = np.array(list(arcs), np.int64)
        order = np.argsort(keys)
        self.width, self.arc_keys, self.arc_to = len(alphabet), keys[order], np.array(list(arcs.values()), np.int64)[order]
        self.ends = np.full(len(arcs) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.single = np.zeros(POINTS, bool)
        self.single[[ord(p) for p in pieces.values() if len(p) == 1]] = True

    def _compile_merges(self) -> None:
        """The acceptor: when each piece is born and of which two, and the score of every two that merge.

        Ranks stand for scores, the best first; a character is there from the start. ``tied`` pieces hold one that is no better than
        what it becomes part of (runs of marks): the walk back in time does not hold for them, so merging is tried.
        """
        scores = sorted(set(self.score.values()), reverse=True)
        place = {x: i for i, x in enumerate(scores)}
        rank = {p: place[x] for p, x in self.score.items()}
        number = {p: i for i, p in enumerate(self.names) if p in self.score}
        of = lambda p: number[p] if p in number else ord(p) + len(self.names)
        states = len(self.names) + POINTS
        self.rank, self.born = rank, np.full(states, -1, np.int32)
        self.left, self.right = np.arange(states, dtype=np.int32), np.arange(states, dtype=np.int32)
        self.tied, pairs = np.zeros(states, bool), {}
        for p, i in number.items():
            if len(p) == 1:
                continue
            for k in range(1, len(p)):
                if (k == 1 or p[:k] in number) and (k == len(p) - 1 or p[k:] in number):
                    pairs[of(p[:k]) * states + of(p[k:])] = rank[p]
            whole, two = merged(p, rank)
            if len(whole) > 1:
                self.unreachable.add(i)
                continue
            self.born[i], self.left[i], self.right[i] = rank[p], of(two[0]), of(two[1])
        for p, i in sorted(number.items(), key=lambda x: len(x[0])):
            parts = [self.left[i], self.right[i]] if self.born[i] >= 0 else []
            self.tied[i] = any(self.tied[x] or self.born[x] >= self.born[i] for x in parts)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def _name(self, piece: int) -> str:
        return self.names[piece] if piece < len(self.names) else chr(piece - len(self.names))

    def passes(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the acceptor lets each piece follow the one before it."""
        key = before * (len(self.names) + POINTS) + piece
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.slot_passes[slot]
        new = np.flatnonzero(self.slot_key[slot] != key)
        if len(new):
            told = self._stay_apart(before[new], piece[new])
            for i in np.flatnonzero(self.tied[before[new]] | self.tied[piece[new]]).tolist():
                two = [self._name(before[new[i]]), self._name(piece[new[i]])]
                told[i] = merged("".join(two), self.rank)[0] == two
            out[new] = told
            self.slot_key[slot[new]] = key[new]
            self.slot_passes[slot[new]] = told
        return out

    def _stay_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the joined texts of two pieces never joins them.

        Back in time from both: of the two at the border the younger is taken apart (of equally old ones the right one, which is
        merged after the left one). They would have merged where their score comes before those by which either was used up.
        """
        out, live = np.ones(len(x), bool), np.arange(len(x))
        until_x = until_y = np.full(len(x), np.iinfo(np.int64).max)
        while len(live):
            key = x * (len(self.names) + POINTS) + y
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = self.pair_rank[place]
            joined = (self.pair_keys[place] == key) & (rank < until_x) & (rank <= until_y)
            out[live[joined]] = False
            born_x, born_y = self.born[x].astype(np.int64), self.born[y].astype(np.int64)
            on = ~joined & ((born_x >= 0) | (born_y >= 0))
            live, x, y, born_x, born_y, until_x, until_y = (v[on] for v in (live, x, y, born_x, born_y, until_x, until_y))
            right = born_y >= born_x
            x, until_x = np.where(right, x, self.right[x]), np.where(right, until_x, born_x)
            y, until_y = np.where(right, self.left[y], y), np.where(right, born_y, until_y)
        return out

    def lattice(self, points: np.ndarray, stop: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compose the trie with a text: start, length and piece of the arcs that begin at its first ``starts`` places.

        ``stop`` is where the word of a place ends; no arc goes further.
        """
        symbol = self.symbol[points]
        at, node, n = np.arange(starts), np.zeros(starts, np.int64), 0
        bare = np.flatnonzero(~self.single[points[:starts]])
        found = [(bare, np.ones(len(bare), np.int64), points[bare].astype(np.int64) + len(self.names))]
        while len(at):
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
            key = node * self.width + symbol[at + n]
            place = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            is_arc = (self.arc_keys[place] == key) & (symbol[at + n] >= 0)
            at, node, n = at[is_arc], self.arc_to[place[is_arc]], n + 1
            full = self.ends[node] >= 0
            found.append((at[full], np.full(np.count_nonzero(full), n), self.ends[node[full]]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _weights(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece < len(self.names), self.weight[np.minimum(piece, len(self.names) - 1)], self.byte_weight)

    def shortest(self, words: list[str]) -> list[bytes]:
        """Ids of the shortest path of each word, all words side by side: a step relaxes the arcs that end at the same place of theirs."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start, length, piece = self.lattice(points, np.repeat(first + size, size), len(points))
        source = start + word[start]  # each word has one place more than characters
        target, depth = source + length, start - first[word[start]] + length
        order = np.argsort(depth * (len(points) + len(words)) + target)
        source, target, piece, depth = source[order], target[order], piece[order], depth[order]
        weight = self._weights(piece)
        cost, last, back = np.full(len(points) + len(words), np.inf), np.zeros(len(points) + len(words), np.int64), np.full(len(points) + len(words), -1)
        roots = first + np.arange(len(words))
        cost[roots] = 0.0
        inner = np.ones(len(cost), bool)
        inner[roots] = False
        steps = np.flatnonzero(np.diff(depth, prepend=0, append=-1)) if len(depth) else []
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            s, t, p = source[a:b], target[a:b], piece[a:b]
            total = cost[s] + weight[a:b]
            if self.merges:
                tested = np.flatnonzero(inner[s])
                total[tested[~self.passes(last[s[tested]], p[tested])]] = np.inf
            group = np.flatnonzero(np.diff(t, prepend=-1))
            least = np.minimum.reduceat(total, group)
            here = np.flatnonzero(total == np.repeat(least, np.diff(group, append=b - a)))[::-1]  # of equal ones the first is set last
            cost[t[here]], last[t[here]], back[t[here]] = total[here], p[here], s[here]
        at, live, steps_back = roots + size, np.arange(len(words)), []
        while len(live):
            steps_back.append((live, last[at]))
            at = back[at]
            on = inner[at]
            at, live = at[on], live[on]
        owner, path = (np.concatenate(c)[::-1] for c in zip(*steps_back, strict=True)) if steps_back else (np.empty(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        path, edges = path[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))].tolist()
        raw, bare = path.astype("<i4").tobytes(), np.zeros(len(words), bool)
        bare[owner[order][path >= len(self.names)]] = True
        return [self._ids(path[a:b].tolist()) if x else raw[4 * a : 4 * b] for a, b, x in zip(edges[:-1], edges[1:], bare.tolist(), strict=True)]

    def shortest_long(self, word: str) -> bytes:
        """The same for one long word, arc by arc in the order of their starts, window after window."""
        points, n = np.frombuffer(word.encode("utf-32-le"), np.uint32), len(word)
        longest = max(map(len, self.score), default=1)
        cost, last, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        cost[0] = 0.0
        for low in range(0, n, WINDOW):
            part = points[low : low + WINDOW + longest]
            start, length, piece = self.lattice(part, np.full(len(part), len(part)), min(WINDOW, n - low))
            order = np.lexsort((length, start))
            near = slice(low, low + len(part) + 1)
            near_cost, near_last, near_back = cost[near].tolist(), last[near].tolist(), back[near].tolist()
            told: dict[tuple[int, int], bool] = {}
            for s, k, p, w in zip(start[order].tolist(), length[order].tolist(), piece[order].tolist(), self._weights(piece)[order].tolist(), strict=True):
                if near_cost[s] + w < near_cost[s + k]:
                    if self.merges and low + s:
                        passes = told.get((near_last[s], p))
                        if passes is None:
                            passes = told[near_last[s], p] = bool(self.passes(np.array([near_last[s]]), np.array([p]))[0])
                        if not passes:
                            continue
                    near_cost[s + k], near_last[s + k], near_back[s + k] = near_cost[s] + w, p, k
            cost[near], last[near], back[near] = near_cost, near_last, near_back
        out, at, last, back = [], n, last.tolist(), back.tolist()
        while at > 0:
            out.append(last[at])
            at -= back[at]
        return self._ids(out[::-1])

    def _ids(self, path: list[int]) -> bytes:
        out: list[int] = []
        for p in path:
            if p < len(self.names):
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(p - len(self.names)).encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.word.findall(self.normalised(t)) for t in texts]
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = set(chain.from_iterable(split)).difference(known)
        once = {}
        batch, chars = [], 0
        for w in [*new, None]:
            if w is None or chars + len(w) > WINDOW:
                known.update(zip(batch, self.shortest(batch), strict=True))
                batch, chars = [], 0
            if w is not None and len(w) > LONG:
                once[w] = self.shortest_long(w)
            elif w is not None:
                batch.append(w)
                chars += len(w)
        at = known.__getitem__
        ids = [b"".join([known[w] if w in known else once[w] for w in words] if once else map(at, words)) for words in split]
        return ids if self.bytes else [self._one_unknown(x) for x in ids]

    def _one_unknown(self, raw: bytes) -> bytes:
        """Unknown characters in a row are one unknown piece."""
        ids = np.frombuffer(raw, "<i4")
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> bytes:
        return self.texts([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces as they are, bytes joined, marks as spaces, without the mark before the text."""
        text = b"".join(map(self.outputs.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
        return text[1:] if self.normalised.prefix and text.startswith(" ") else text


def worker_transducer(model: str) -> Transducer:
    """The transducer of this Python worker; ``model`` is a path, or the name of a public one of the machine."""
    kept = sys.modules.setdefault("pieces_worker", ModuleType("pieces_worker"))
    if model not in vars(kept):
        path = model
        if not os.path.isabs(model):
            import public_tokenizers

            path = public_tokenizers.path(model)
        with open(path, "rb") as f:
            setattr(kept, model, Transducer(f.read()))
    return getattr(kept, model)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded text."""
    at, size, column = 0, 0, batch.column(column)
    for k in range(batch.num_rows):
        size += len(column[k].as_py() or "")
        if size >= SLICE or k == batch.num_rows - 1:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = worker_transducer(model)
        for whole in batches:
            for batch in _slices(whole, 1):
                ids = transducer.texts([t or "" for t in batch.column(1).to_pylist()])
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = worker_transducer(model)
        for batch in batches:
            texts, crc = [], []
            for ids in batch.column(batch.num_columns - 1):
                ids = np.asarray(ids.values, np.int32)
                texts.append(transducer.decode(ids))
                crc.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in batch.column(batch.num_columns - 1)], pa.int64()), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], [*batch.schema.names[:-1], "n_ids", "ids_crc32", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` (doc_id, text) with ids, an array of piece numbers. A null or empty text has none; nothing is cut off."""
    docs = narrow(docs, "doc_id", "text")
    return docs.mapInArrow(_encode(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decode_pieces(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``tokens`` (doc_id, text, ids): n_ids, ids_crc32 (unsigned, over little-endian 32-bit ids) and the decoded text."""
    return tokens.mapInArrow(_decode(model), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string, n_ids bigint, ids_crc32 bigint, decoded string")


def op3_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and round_trip: whether decoding the ids gives the text back."""
    out = decode_pieces(encode_pieces(docs))
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))

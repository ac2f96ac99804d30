"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and those of its neighbours. The field is fitted on a bounded sample of
labelled documents: at first the lines of a document have its label, then the lines of bad documents are labelled anew by what the field
makes of them. Forward-backward marginals, weighted by the length of the lines, give a document's share of good text, which a
logistic curve turns into the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import capped, held_out, narrow, settle

#: Labelled documents of either class that the field is fitted on at most.
MAX_FIT = 2500
#: Lines of either class after which no further document is fitted on; every document is fitted and scored whole.
FIT_LINES = 1_000_000
THRESHOLD = 0.3
ROUNDS, STEPS = 2, 120
#: Bytes of text whose features are computed at a time.
SLICE_BYTES = 2 << 20

#: Frequent words of four languages.
STOP_WORDS = frozenset(w.encode() for w in "a and are as at be by for from in is it not of on or that the this to was with au avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui sur un une das dem den der die ein eine für im ist mit nicht sich und von zu auf al como con del el los las lo no o para por se su una y".split())
#: Classes of bytes that are counted: symbols, pipes, capitals, exclamation marks, digits, punctuation, bytes beyond ASCII, white space.
CLASSES = (b"#*$%&<>", b"|", bytes(range(65, 91)), b"!", b"0123456789", b".,;:", bytes(range(128, 256)), b" \t\x0b\x0c\r")
OWN = 13
#: Own features whose values for the lines before and after are features too.
NEIGHBOUR = (1, 2, 3, 4, 7, 8)
WIDTH = OWN + 2 * len(NEIGHBOUR) + 3

_TABLE = np.zeros((len(CLASSES), 256), bool)
for _k, _class in enumerate(CLASSES):
    _TABLE[_k, list(_class)] = True


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of ``texts``, the length of each line, and the number of lines of each text."""
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(lines) for lines in split], np.int64)
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(whole == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    share = np.empty((len(ends), len(CLASSES)))
    for k in range(len(CLASSES)):
        running = np.r_[0, np.cumsum(_TABLE[k][whole], dtype=np.int64)]
        share[:, k] = running[ends] - running[starts]
    spaces = share[:, 7].copy()
    share /= np.maximum(length, 1)[:, None]
    repeat, stop, words, again = (np.zeros(len(ends)) for _ in range(4))
    i = 0
    for lines in split:
        seen: set[bytes] = set()
        for line in lines:
            w = line.split()
            if w:
                kinds = set(w)
                repeat[i] = 1 - len(kinds) / len(w)
                stop[i] = len(kinds & STOP_WORDS) / len(kinds)
                words[i] = len(w)
                again[i] = line in seen
                seen.add(line)
            i += 1
    own = np.column_stack([np.log1p(length) / 5, share[:, 0], share[:, 1] * 5, share[:, 2], share[:, 3] * 5, share[:, 4], share[:, 5], repeat, stop, (length - spaces) / np.maximum(words, 1) / 10, words == 0, again, share[:, 6]])
    first = np.zeros(len(ends), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(ends), bool)
    last[np.cumsum(counts) - 1] = True
    near = own[:, NEIGHBOUR]
    before, after = np.roll(near, 1, axis=0), np.roll(near, -1, axis=0)
    before[first], after[last] = near[first], near[last]
    return np.column_stack([own, before, after, first, last, np.ones(len(ends))]), length + 1, counts


def marginals(score: np.ndarray, counts: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """P(good) of every line, from ``score`` (log-odds by its features) and ``transition`` (from, to; 0 bad, 1 good).

    Documents go side by side, the longest first, so a step handles the same line of all. With ``pairs``, also the expected
    numbers of transitions and the sum of the log-partitions.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # documents with more than t lines
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    for t in range(longest):
        at = starts[: active[t]] + t
        forward[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(forward[at - 1, :1] + transition[0], forward[at - 1, 1:] + transition[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = emit[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    if not pairs:
        return good
    inner = np.ones(len(score), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    expected = np.array([[np.exp(forward[at - 1, i] + transition[i, j] + emit[at, j] + backward[at, j] - total[at]).sum() for j in range(2)] for i in range(2)])
    return good, expected, inner


def fit_field(x: np.ndarray, counts: np.ndarray, doc_good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the conditional likelihood, in ROUNDS of labelling the lines of bad documents."""
    of = np.repeat(np.arange(len(counts)), counts)
    label = doc_good[of].astype(float)
    balance = np.where(doc_good, 0.5 / max(1, doc_good.sum()), 0.5 / max(1, (~doc_good).sum()))[of] * len(counts)
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        m = [np.zeros_like(weights), np.zeros_like(transition)]
        v = [np.zeros_like(weights), np.zeros_like(transition)]
        for step in range(1, STEPS + 1):
            good, expected, inner = marginals(x @ weights, counts, transition, pairs=True)
            at = np.flatnonzero(inner)
            seen = np.array([[np.sum((label[at - 1] == i) & (label[at] == j)) for j in range(2)] for i in range(2)])
            grads = [x.T @ ((label - good) * balance) / len(x) - 1e-4 * weights, (seen - expected) / len(x) - 1e-3 * transition]
            for k, (value, grad) in enumerate(zip((weights, transition), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                value += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        good = marginals(x @ weights, counts, transition)
        label = np.where(doc_good[of], 1.0, (good > 0.5).astype(float))
    return weights, transition


def good_share(good: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at = np.cumsum(counts) - counts
    return np.add.reduceat(good * length, at) / np.add.reduceat(length, at)


def fit_curve(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from shares to labels, by Newton steps with a slight prior."""
    x = np.column_stack([share - 0.5, np.ones(len(share))])
    beta = np.array([4.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (label - p) - 0.5 * (beta - np.array([4.0, 0.0])))
    return float(beta[0]), float(beta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, length, counts = line_features([t or b"" for t in batch.column(0).to_pylist()])
        at = np.cumsum(counts) - counts
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[a : a + n].astype(np.float32).tobytes() for a, n in zip(at, counts, strict=True)], pa.binary()), pa.array([length[a : a + n].tobytes() for a, n in zip(at, counts, strict=True)], pa.binary())], ["quality", "x", "length"])


def _scores(model):
    mean, scale, weights, transition, slope, offset = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t or b"" for t in batch.column(1).to_pylist()], 0
            out = []
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size == 0 or size + len(texts[upto]) < SLICE_BYTES):
                    size += len(texts[upto]) + 1
                    upto += 1
                x, length, counts = line_features(texts[at:upto])
                share = good_share(marginals(((x - mean) / scale) @ weights, counts, transition), length, counts)
                out.append(1 / (1 + np.exp(-np.clip(slope * (share - 0.5) + offset, -30, 30))))
                at = upto
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return run


def _whole_documents(sample: DataFrame, most: int = FIT_LINES) -> DataFrame:
    """The documents of either class with the smallest keys, up to the one with which they have ``most`` lines."""
    lines = F.coalesce(F.length("text") - F.length(F.translate(F.col("text").cast("string"), "\n", "").cast("binary")), F.lit(0)) + 1
    before = F.sum("lines").over(W.partitionBy("quality").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    return sample.withColumn("lines", lines).withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < most).select("text", "quality")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted.

    Null and empty texts are one empty line. Null labels teach nothing. Without labels of both classes every score is 0.5.
    """
    docs = narrow(docs, "doc_id", "text")
    labels = narrow(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    few = [capped(labels.filter(F.col("quality") == y), F.col("doc_id"), MAX_FIT) for y in (0, 1)]
    sample = docs.join(F.broadcast(few[0].unionByName(few[1])), "doc_id").select(F.col("text").cast("binary").alias("text"), "quality", F.xxhash64("doc_id", "text").alias("key"))
    sample = _whole_documents(settle(sample, "quality-sample"))
    rows = sorted(sample.mapInArrow(_features, "quality int, x binary, length binary").collect(), key=lambda r: (r["quality"], r["x"]))
    good = np.array([r["quality"] == 1 for r in rows], bool)
    if len(rows) and good.any() and not good.all():
        x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]).astype(float)
        length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in rows])
        counts = np.array([len(r["length"]) // 8 for r in rows])
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        mean[-1], scale[-1] = 0, 1
        weights, transition = fit_field((x - mean) / scale, counts, good)
        share = good_share(marginals(((x - mean) / scale) @ weights, counts, transition), length, counts)
        slope, offset = fit_curve(share, good.astype(float))
    else:
        mean, scale, weights, transition, slope, offset = np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 0.0
    body = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    scored = body.mapInArrow(_scores((mean, scale, weights, transition, slope, offset)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

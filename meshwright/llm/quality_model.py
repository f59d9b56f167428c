"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Random indexing gives each word bucket and each word shape a sparse ternary index vector; its context
vector is the sum of the index vectors around it, over the training texts. Sums are of integers, so
their order doesn't matter. A document is pooled to the means of its words' and shapes' context
vectors, its share of words that repeat the word before, and its length. A two-layer numpy network
is trained on that, and one part of the training documents, not trained on, sets the temperature
that makes its probabilities honest. Words not met in training still count by their shapes.

Training takes a bounded sample of labelled documents (train_docs); scoring takes every text whole.

Defined results: a null text is scored like an empty one. Without training labels of both kinds the
score is the smoothed share of label 1. Repeated rows score alike; a null doc_id isn't held out. An
empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_bucket, labelled_sample

WORD_BITS, SHAPE_BITS, DIM, NONZERO, REACH = 14, 10, 32, 4, 2
TRAIN_DOCS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 0.01, 1e-4
TABLE_LIMIT = 400_000
#: Words whose vectors are in memory at a time.
SLICE_WORDS = 1 << 15
_RUNS = (re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"), re.compile(rb"([^a-zA-Z0-9])\1+"))


def shape(word: bytes) -> bytes:
    """Runs of lower case, upper case and digits as one letter each, repeated other characters as one."""
    for pattern, to in zip(_RUNS, (b"a", b"A", b"0", rb"\1")):
        word = pattern.sub(to, word)
    return word


class Codes(dict):
    """word -> bucket of the word and bucket of its shape, packed; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word.lower()) >> (32 - WORD_BITS) << SHAPE_BITS | zlib.crc32(shape(word)) >> (32 - SHAPE_BITS)
        if len(self) >= TABLE_LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_codes = Codes()


def buckets(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    words = (text or b"").split()
    code = np.fromiter(map(_codes.__getitem__, words), dtype=np.int64, count=len(words))
    return code >> SHAPE_BITS, code & ((1 << SHAPE_BITS) - 1)


def index_vectors(bits: int, seed: int) -> np.ndarray:
    """A sparse ternary vector for each bucket: NONZERO entries of 1 or -1 in DIM."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << bits, DIM), dtype=np.int32)
    at = rng.permuted(np.tile(np.arange(DIM), (1 << bits, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.int32), size=at.shape), axis=1)
    return out


def add_contexts(sums: np.ndarray, index: np.ndarray, ids: np.ndarray) -> None:
    """Add to each bucket's context vector the index vectors up to REACH places away.

    Slices, which see REACH places beyond their ends, bound the memory that a very long text takes.
    """
    for a in range(0, len(ids), SLICE_WORDS):
        z = min(len(ids), a + SLICE_WORDS)
        around = np.zeros((z - a, DIM), dtype=np.int32)
        for d in range(1, REACH + 1):
                start, stop = min(z, max(a, d)), max(a, min(z, len(ids) - d))  # places with a neighbour at that distance
                if start < z:
                    around[start - a :] += index[ids[start - d : z - d]]
                around[: stop - a] += index[ids[a + d : stop + d]]
        mine = ids[a:z]
        order = np.argsort(mine, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(mine[order]) > 0])
        sums[mine[order][first]] += np.add.reduceat(around[order], first, axis=0)


def context_vectors(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors of word and shape buckets over a sample of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [index_vectors(WORD_BITS, 1), index_vectors(SHAPE_BITS, 2)]
        sums = [np.zeros(x.shape, dtype=np.int64) for x in index]
        for batch in batches:
            for t in batch.column("text"):
                for which, ids in enumerate(buckets(t.as_py())):
                    if len(ids):
                        add_contexts(sums[which], index[which], ids)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sums], pa.binary())], names=["sums"])

    words = np.zeros((1 << WORD_BITS, DIM), dtype=np.int64)
    shapes = np.zeros((1 << SHAPE_BITS, DIM), dtype=np.int64)
    # One pair of fixed-size tables a partition, of the sample's eight at most.
    for r in sample.select(F.col("text").cast("binary").alias("text")).coalesce(8).mapInArrow(run, "sums binary").toLocalIterator():
        part = np.frombuffer(r.sums, dtype=np.int64).reshape(-1, DIM)
        if len(part) == len(words):
            words += part
        else:
            shapes += part
    return tuple((x / np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32) for x in (words, shapes))


def pooled(text: bytes | None, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The features of one document."""
    w, s = buckets(text)
    if not len(w):
        return np.zeros(2 * DIM + 2, dtype=np.float32)
    again = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
    # Slices bound the memory that a very long text takes.
    total = np.zeros(2 * DIM, dtype=np.float64)
    for i in range(0, len(w), SLICE_WORDS):
        total[:DIM] += words[w[i : i + SLICE_WORDS]].sum(axis=0)
        total[DIM:] += shapes[s[i : i + SLICE_WORDS]].sum(axis=0)
    return np.r_[total / len(w), again, np.log1p(len(w)) / 10].astype(np.float32)


class Network:
    """Inputs standardised, one tanh layer, one logistic output over a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        held = rng.random(len(x)) < 0.2
        if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
            held[:] = False
        train, target = x[~held], y[~held]
        self.mean, self.scale = train.mean(axis=0), train.std(axis=0) + 1e-3
        z = (train - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(z), BATCH):
                at = order[i : i + BATCH]
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - target[at]) / len(at)
                dh = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[at].T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for a, g, mm, vv in zip(p, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logits = self.logits(x[held])
            options = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
            losses = [np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / t).mean() for t in options]
            self.temperature = float(options[int(np.argmin(losses))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Prior:
    """What stands in for the network without labels of both kinds."""

    def __init__(self, y: np.ndarray):
        self.share = (float(y.sum()) + 1) / (len(y) + 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, label: str = "quality", held_out=None):
    """(word vectors, shape vectors, network), fitted on at most train_docs labelled documents that aren't held out."""
    held_out = held_out if held_out is not None else crc_bucket(F.col("doc_id"), 3) == 1
    sample = labelled_sample(docs, labels, label, ~held_out, train_docs)
    words, shapes = context_vectors(sample)
    wide = sample.sparkSession.sparkContext.broadcast((words, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t.as_py(), *wide.value).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    rows = sample.select("doc_id", F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([r.label for r in rows], dtype=np.float64)
    if len({*y}) < 2:
        return words, shapes, Prior(y)
    return words, shapes, Network().fit(np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows], dtype=np.float64), y)


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, network = model.value
        for batch in batches:
            x = np.array([pooled(t.as_py(), words, shapes) for t in batch.column("text")], dtype=np.float64).reshape(-1, 2 * DIM + 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.score(x))], names=["doc_id", "score"])

    scored = bound_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

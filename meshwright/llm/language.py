"""Language identification by nearest centroid.

A text is lower-cased, characters other than letters become spaces, and its byte trigrams are hashed
to BINS counts. These are damped, weighted by inverse document frequency and normalised. Each language
has several centroids, from spherical k-means over a bounded sample of its documents; the language
of the most similar one by cosine is predicted. A text further from its centroid than nearly all of
that language's training documents is rejected.

Document frequencies and the number of documents of each language cover all documents that may be
learned from. Only these tables, of fixed size, and the sample reach the driver.

Defined results: und, score 0, for a text that is null or has no letter (numerals and marks such as ² or Ⅷ aren't letters); also if nothing can be
learned. Every language with a document that may be learned from is learned, at CENTROIDS documents or more if it
has them; so train_docs is exceeded where there are more than a third of it languages. Ties go to the smaller language name. A null doc_id is learned from and isn't held out.
Repeated rows are predicted alike. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, crc_bucket, materialize

BINS = 4096
CENTROIDS, ROUNDS = 3, 12
#: Documents from which centroids are fitted, over all languages together.
TRAIN_DOCS = 2400
#: Share of a language's training documents that its own rejection distance lets through.
ACCEPTED = 0.995
UNKNOWN = "und"
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text. Slices bound the memory that a very long text takes."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_BLANK), dtype=np.uint8)
    out = np.zeros(BINS, dtype=np.int64)
    for i in range(0, max(1, len(raw) - 2), 1 << 20):
        x = raw[i : i + (1 << 20) + 2].astype(np.uint32)
        out += np.bincount((x[:-2] * _MIX[0] + x[1:-1] * _MIX[1] + x[2:] * _MIX[2]) >> np.uint32(20), minlength=BINS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Up to k unit centroids. Starts are far apart: each is the row least like those before."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    centers = x[start]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.array([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    return centers.astype(np.float32)


class Model:
    """idf, the centroids (rows) with their languages, and the least cosine that each language accepts."""

    def __init__(self, idf: np.ndarray, languages: list[str], centers: np.ndarray, owner: np.ndarray, accept: np.ndarray):
        self.idf, self.languages, self.centers, self.owner, self.accept = idf, languages, centers, owner, accept

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        written = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for i in range(0, len(written), 256):
            part = written[i : i + 256]
            cosine = vectors(np.array([gram_counts(texts[j]) for j in part]), self.idf) @ self.centers.T
            best = cosine.argmax(axis=1)  # centers are ordered by language, and the first of equal ones is taken
            for j, c, s in zip(part, best.tolist(), cosine.max(axis=1).tolist()):
                s = min(1.0, max(0.0, float(s)))
                out[j] = (self.languages[self.owner[c]], s, s < self.accept[self.owner[c]])
        return out


def _learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False)))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that hold each gram, over all rows; one fixed-size table a partition, summed by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                total += gram_counts(t.as_py()) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "n"])

    out = np.zeros(BINS, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def first_of_each(known: DataFrame, each: int) -> DataFrame:
    """(lang, text): of each language the rows that come first by a hash of id and text, up to each; of a row that repeats one.

    Every language has some, however many there are. A task cuts its own rows to each a language before
    hashes are shuffled, and texts are read again for those up to a language's last hash alone.
    """
    hashed = known.select("lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("h"), "text")
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    last = hashed.select("lang", "h", place.alias("place")).filter(F.col("place") <= each).groupBy("lang").agg(F.max("h").alias("last"))
    return hashed.join(materialize(last), "lang").filter("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, held_out: Column | None = None) -> Model:
    """Learn from the documents with a language that aren't held out."""
    held_out = held_out if held_out is not None else crc_bucket(F.col("doc_id"), 4) == 2
    known = _learnable(docs, held_out)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Model(np.ones(BINS, dtype=np.float32), [], np.zeros((0, BINS), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    n = sum(sizes.values())
    idf = np.log((1 + n) / (1 + document_frequencies(known))).astype(np.float32) + 0.05
    each = max(CENTROIDS, train_docs // len(sizes))
    sample = first_of_each(known, each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.log1p(gram_counts(t.as_py())).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append(bytes(r.x))
    languages, centers, owner, accept = sorted(found), [], [], []
    for i, lang in enumerate(languages):
        x = np.array([np.frombuffer(b, dtype=np.float16) for b in sorted(found[lang])]).astype(np.float32) * idf
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        own = spherical_kmeans(x, CENTROIDS)
        centers.append(own)
        owner += [i] * len(own)
        accept.append(float(np.quantile((x @ own.T).max(axis=1), 1 - ACCEPTED)))
    return Model(idf, languages, np.concatenate(centers), np.array(owner), np.array(accept))


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, reject: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per document. reject: predict und beyond the rejection distance."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.predict(batch.column("text").to_pylist())
            langs = [UNKNOWN if reject and far else lang for lang, _, far in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([f for *_, f in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    found = bound_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

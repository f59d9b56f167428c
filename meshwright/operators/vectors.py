"""Vector search: exact cosine top-k, filtered, and pluggable embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import embedding_document
from ..schema import EMBEDDINGS
from ..tables import materialize

Embedder = Callable[[list[str]], list[list[float]]]
DIMENSIONS = 256
#: Probes of one scan, about: their matrix is broadcast, and a task holds some top_k rows and scores for each.
PROBES = 512
#: Scores that may be as good as the kth by rounding alone: a matrix product adds in another order than cosine().
_NEAR = 1e-9


#: What separates words: white space, points and underscores.
_SEPARATORS = np.array([c for c in range(0x3001) if chr(c).isspace() or chr(c) in "._"], dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PP = np.uint64(int(_P) ** 2 % 2**64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def hashed_ngrams(texts: list[str]) -> list[list[float]]:
    """The default embedder: signed hashed character trigrams and words, of unit length. No model, no network.

    A batch is one array of code points; a gram's hash is a sum of code points times powers, so those of
    all grams are made at once: of trigrams by shifting the array, of words by sums over segments.
    """
    if not texts:
        return []
    lows = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = points.astype(np.uint64)
    ends = np.cumsum([len(t) for t in lows])
    owner = np.repeat(np.arange(len(lows)), np.diff(np.r_[0, ends]))
    inside = owner[:-2] == owner[2:]
    trigrams = _mixed((c[:-2] + np.uint64(1)) + c[1:-1] * _P + c[2:] * _PP)[inside]
    # Texts begin and end with a blank, so that no run of letters crosses from one to the next.
    letter = ~np.isin(points, _SEPARATORS)
    starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    hashes, owners = trigrams, owner[:-2][inside]
    if len(starts):
        lengths = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1 - starts
        powers = np.cumprod(np.r_[np.uint64(1), np.full(lengths.max(), _P)])
        place = np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))]
        terms = np.where(letter, (c + np.uint64(1)) * powers[np.where(letter, place, 0)], np.uint64(0))
        words = _mixed(np.add.reduceat(terms, starts) + powers[lengths] * _Q)
        hashes, owners = np.r_[hashes, words], np.r_[owners, owner[starts]]
    at = owners * DIMENSIONS + (hashes % np.uint64(DIMENSIONS)).astype(np.int64)
    v = np.bincount(at, weights=np.where(hashes >> np.uint64(63), 1.0, -1.0), minlength=len(lows) * DIMENSIONS).reshape(len(lows), DIMENSIONS)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1.0)).tolist()


def embed(nodes: DataFrame, embedder: Embedder = hashed_ngrams, batch: int = 64, limit_per_type: int = 0) -> DataFrame:
    """An embedding row for each node other than directories; limit_per_type > 0 takes the most important ones only."""
    wanted = nodes.filter(F.col("node_type") != "Directory")
    if limit_per_type:
        order = W.partitionBy("node_type").orderBy(F.desc("importance_score"), "node_id")
        wanted = wanted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit_per_type)
    rows = wanted.select(
        "repo_id", "node_id", embedding_document(F.col("node_type"), F.col("fqn"), F.col("docstring"), F.col("file_path")).alias("document"),
        "node_type", "fqn", "file_path", "language", "importance_score",
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["document"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield part.assign(embedding=vectors)[[f.name for f in EMBEDDINGS]]

    return rows.mapInPandas(run, EMBEDDINGS)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays, in double precision; null if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm > 0, norm)


def search(vectors: DataFrame, query: list[float], top_k: int = 20, where: dict[str, object] | None = None, id_col: str = "node_id") -> DataFrame:
    """vectors with score, the top_k nearest by cosine; where: equalities, applied before any distance."""
    for column, value in (where or {}).items():
        vectors = vectors.filter(F.col(column) == value)
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), id_col).limit(top_k)


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, matrix): the vectors of that width that have a length, scaled to 1."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    rows = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(rows)).flatten()
    m = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # a null entry is NaN
    norm = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], m[good] / norm[good, None]


def _nearest(batches: Iterator[pa.RecordBatch], probes: np.ndarray, top_k: int, block: int = 1024) -> Iterator[pa.RecordBatch]:
    """(probe, row): for each probe the rows of the task that may be among its top_k nearest: those no worse than the task's kth."""
    held: pa.Table | None = None
    scores = np.full((len(probes), 0), -2.0)
    for batch in batches:
        for i in range(0, batch.num_rows, block):
            part = batch.slice(i, block)
            rows, m = _matrix(part.column("embedding"), probes.shape[1])
            if not len(rows):
                continue
            fresh = pa.Table.from_batches([part.take(pa.array(rows))])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            scores = np.concatenate([scores, probes @ m.T], axis=1)
            if scores.shape[1] > top_k:
                least = np.partition(scores, -top_k, axis=1)[:, [-top_k]] - _NEAR
                scores = np.where(scores >= least, scores, -2.0)
                kept = np.flatnonzero((scores > -2.0).any(axis=0))  # rows that some probe still wants
                held, scores = held.take(pa.array(kept)), scores[:, kept]
    if held is None:
        return
    for p in range(len(probes)):
        found = np.flatnonzero(scores[p] > -2.0)
        for batch in held.take(pa.array(found)).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, p, dtype=np.int64)), *batch.columns], names=["probe", *batch.schema.names])


def search_many(vectors: DataFrame, probes: DataFrame, top_k: int = 20, where: dict[str, object] | None = None, id_col: str = "node_id", probe_id: str = "probe_id") -> DataFrame:
    """(probe_id, columns of vectors, score, rank): search() for each of probes (probe_id, embedding; ids unique), PROBES of them in a scan.

    A task multiplies blocks of vectors with the matrix of the probes and keeps, for each of them, the rows
    that may be among its nearest; these alone are shuffled, and scored as search() scores. Rows of equal
    score at a task's end stay together, so ties to smaller ids are exact. Probes and vectors that are null,
    of length 0, with null or non-finite entries, or of another width than that of the probe with the smallest id, have no score
    and no row.
    """
    for column, value in (where or {}).items():
        vectors = vectors.filter(F.col(column) == value)
    spark, id_type, q_type = vectors.sparkSession, probes.schema[probe_id].dataType, probes.schema["embedding"].dataType
    asked = materialize(probes.select(F.col(probe_id).alias("__id"), "embedding").filter("size(embedding) > 0"))
    found = [vectors.limit(0).select(F.lit(None).cast(id_type).alias(probe_id), "*", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))]
    width, n = asked.agg(F.min_by(F.size("embedding"), "__id"), F.count("*")).first()
    blocks = -(-n // PROBES)
    for block in range(blocks):
        rows = asked.filter((F.pmod(F.xxhash64("__id"), F.lit(blocks)) == block) & (F.size("embedding") == width)).collect()
        ok, matrix = _matrix(pa.array([r.embedding for r in rows], type=pa.list_(pa.float64())), width)
        if not len(ok):
            continue
        sent = spark.sparkContext.broadcast(matrix)
        near = vectors.mapInArrow(lambda batches, sent=sent: _nearest(batches, sent.value, top_k), T.StructType([T.StructField("probe", T.LongType()), *vectors.schema]))
        named = [(n, rows[i]["__id"], rows[i].embedding) for n, i in enumerate(ok.tolist())]
        names = spark.createDataFrame(named, T.StructType([T.StructField("probe", T.LongType()), T.StructField(probe_id, id_type), T.StructField("__q", q_type)]))
        scored = near.join(F.broadcast(names), "probe").withColumn("score", cosine(F.col("embedding"), F.col("__q"))).drop("probe", "__q")
        best = W.partitionBy(probe_id).orderBy(F.desc("score"), id_col)
        found.append(materialize(scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select(found[0].columns)))
    return reduce(DataFrame.unionByName, found)

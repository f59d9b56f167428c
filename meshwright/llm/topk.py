"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every candidate, a block of queries with a block of rows at a time.
Rounds of score histograms, summed over all tasks, narrow the range that holds a query's kth highest
score until it is one integer; then what is above it is taken, and ties at it go to the smallest ids.
A task reports only histogram bins from its own kth score up: the global kth score can't be lower
than any task's, so the sums that locate it are exact, and a round moves about k rows a query and
task whatever the number of candidates or of equal vectors.

Blocks of queries carry their ranges with them. They are rows of a table like the candidates' blocks,
so that all queries go through a round together and none through the driver.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part,
nor do rows without an id. Vectors of different lengths are compared with their like only. A query
is compared with every row but those of its own id; rows that repeat an id and vector are candidates
of their own. Of a query id with several vectors each is searched, and their hits are ranked together;
a vector that it repeats is searched once. With fewer than k candidates all are returned. Scores are
64-bit integers: a vector with a quantized component of 2**62 or more in size takes no part, and a
pair whose score would be of that size is no hit. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import discard
from .common import bound_batches, materialize

#: Bins of one round; the score range shrinks by this factor a round.
BINS = 8192
#: Queries and candidates of one matrix product: 8 MB of scores.
BLOCK_QUERIES, BLOCK_ROWS = 256, 4096
#: Scores and components are below this in size.
LIMIT = 1 << 62

_BLOCK = "block bigint, length int, ids binary, matrix binary"
_STATE = _BLOCK + ", low binary, width binary"


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double; only rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * float(scale) < float(LIMIT)), F.lit(False)))
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v"))


def products(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Integer inner products, exact, and which of them are below LIMIT in size (None: all).

    By floating point while all sums stay below 2**53, by 64-bit integers while they fit these, else by
    Python's integers.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64), None
    if most < LIMIT:
        return queries @ rows.T, None
    exact = queries.astype(object) @ rows.astype(object).T
    fits = (np.abs(exact) < LIMIT).astype(bool)
    return np.where(fits, exact, 0).astype(np.int64), fits


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows in blocks of up to size vectors of one length: block (unique), length, ids and matrix as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def out(n):
            nonlocal made
            made += 1
            ids, matrix = held.pop(n)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.array([n], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(matrix).tobytes()], pa.binary())],
                names=["block", "length", "ids", "matrix"],
            )

        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            ids, flat = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy()
            first = np.r_[0, np.cumsum(lengths)]
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                while len(at):
                    mine = held.setdefault(n, ([], []))
                    room = size - sum(map(len, mine[0]))
                    mine[0].append(ids[at[:room]])
                    mine[1].append(flat[first[at[:room]][:, None] + np.arange(n)])
                    if room <= len(at):
                        yield out(n)
                    at = at[room:]
        for n in list(held):
            yield out(n)

    return bound_batches(rows).mapInArrow(run, _BLOCK)


def _numbers(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=np.int64)


def _scored(batches: Iterator[pa.RecordBatch]):
    """(block of queries, its ids, low, width, ids of rows, scores, which count) of each pair of blocks; a query block's pairs follow one another."""
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            n = columns["length"][i].as_py()
            if columns["r_length"][i].as_py() != n:
                continue
            q_ids, ids, low, width = (_numbers(columns[c][i]) for c in ("ids", "r_ids", "low", "width"))
            scores, fits = products(_numbers(columns["matrix"][i]).reshape(-1, n), _numbers(columns["r_matrix"][i]).reshape(-1, n))
            others = ids[None, :] != q_ids[:, None]
            yield columns["block"][i].as_py(), q_ids, low, width, ids, scores, others if fits is None else others & fits


def _histograms(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, query, bin, n): bin BINS counts what is above the range. Bins below a task's kth score are left out."""
        block, table = None, None

        def out():
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            q, b = np.nonzero((table > 0) & (above < k))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block), pa.int64()), pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(table[q, b], pa.int64())], names=["block", "query", "bin", "n"])

        for at, q_ids, low, width, _, scores, counts in _scored(batches):
            if at != block:
                if block is not None:
                    yield out()
                block, table = at, np.zeros((len(q_ids), BINS + 1), dtype=np.int64)
            bins = np.minimum((scores - low[:, None]) // width[:, None], BINS)
            flat = (bins + (BINS + 1) * np.arange(len(q_ids))[:, None])[counts & (bins >= 0)]
            table += np.bincount(flat, minlength=table.size).reshape(table.shape)
        if block is not None:
            yield out()

    return run


def _selection(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, score): all above the kth score; of those at it the task's k smallest ids."""
        block, asked, kth, ties = None, None, None, {}

        def rows(q, v, s):
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

        def tied():
            for q, ids in ties.items():
                yield rows(np.full(len(ids), asked[q]), ids, np.full(len(ids), kth[q]))

        for at, q_ids, low, _, ids, scores, counts in _scored(batches):
            if at != block:
                yield from tied()
                block, asked, kth, ties = at, q_ids, low, {}
            q, c = np.nonzero(counts & (scores > low[:, None]))
            if len(q):
                yield rows(q_ids[q], ids[c], scores[q, c])
            same = counts & (scores == low[:, None])
            for q in np.flatnonzero(same.any(axis=1)).tolist():
                ties[q] = np.sort(np.r_[ties.get(q, np.zeros(0, np.int64)), ids[same[q]]])[:k]
        yield from tied()

    return run


def _starting(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with the range of all scores: |score| <= |q|_1 * largest component of a row."""
        for batch in batches:
            lows, widths = [], []
            for m, n in zip(batch.column("matrix"), batch.column("length").to_pylist()):
                bound = [min(LIMIT, sum(map(abs, row)) * reach) for row in _numbers(m).reshape(-1, n).tolist()]
                lows.append(np.array([-b for b in bound], dtype=np.int64).tobytes())
                widths.append(np.array([-(-(2 * b + 1) // BINS) for b in bound], dtype=np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows, pa.binary()), pa.array(widths, pa.binary())], names=[*batch.schema.names, "low", "width"])

    return run


def _narrowed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with the range of each kth score's bin, and whether all of these are single integers."""
        for batch in batches:
            lows, widths, done = [], [], []
            for low, width, placed in zip(batch.column("low"), batch.column("width"), batch.column("placed").to_pylist()):
                low, width = _numbers(low).copy(), _numbers(width).copy()
                found = {p["query"]: (p["bin"], p["upto"]) for p in placed or []}
                open_ = False
                for q in range(len(low)):
                    b, upto = found.get(q, (0, 0))
                    if upto < k:  # fewer than k candidates: everything is taken
                        low[q], width[q] = -LIMIT, 1
                    elif width[q] > 1:
                        low[q] += b * width[q]
                        width[q] = -(-width[q] // BINS)
                        open_ = True
                    else:
                        low[q] += b
                lows.append(low.tobytes())
                widths.append(width.tobytes())
                done.append(not open_)
            kept = [batch.column(c) for c in ("block", "length", "ids", "matrix")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lows, pa.binary()), pa.array(widths, pa.binary()), pa.array(done, pa.bool_())], names=["block", "length", "ids", "matrix", "low", "width", "done"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row that is_query (a Column over vec_id) holds for."""
    rows = materialize(quantize(vectors, id_col, vec_col, scale))
    reach = rows.agg(F.coalesce(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.lit(0))).first()[0]
    candidates = materialize(blocks(rows, BLOCK_ROWS)).select(F.col("length").alias("r_length"), F.col("ids").alias("r_ids"), F.col("matrix").alias("r_matrix"))
    asked = blocks(rows.filter(is_query).distinct(), BLOCK_QUERIES)
    state = materialize(asked.mapInArrow(_starting(reach), _STATE))
    # A stated query set against all rows, block by block; lengths are compared in the block product, as one length may have all rows.
    pairs = lambda: bound_batches(state.drop("done")).crossJoin(candidates)
    while True:
        counts = pairs().mapInArrow(_histograms(k), "block bigint, query int, bin int, n bigint").groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))
        # The bin of the kth: the highest one down to which k scores are counted, or the lowest of all.
        down = W.partitionBy("block", "query").orderBy(F.desc("bin"))
        upto = counts.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") - F.col("n") < k)
        kth = upto.groupBy("block", "query").agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"))
        placed = kth.groupBy("block").agg(F.collect_list(F.struct("query", "bin", "upto")).alias("placed"))  # BLOCK_QUERIES at most
        before, state = state, materialize(state.drop("done").join(placed, "block", "left").mapInArrow(_narrowed(k), _STATE + ", done boolean"))
        discard(before)
        if state.filter("not done").isEmpty():
            break
    hits = pairs().mapInArrow(_selection(k), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

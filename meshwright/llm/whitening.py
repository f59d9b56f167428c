"""Whitening of embeddings onto their principal components, from the covariance of exactly centred rows.

Components of a vector become integers, so sums over all rows are exact. A row is centred as n times
its value minus the sum, an integer too, and is rounded but once, when that is divided by n. MLlib's
RowMatrix adds up the products of these rows; divided by n that is the covariance, a table of the
square of the dimension, whose eigenvectors are found on the driver. The projection, as wide as the
components that are asked for, is broadcast, and rows are whitened in batches.

Defined results: vectors that are null or empty, or hold null or non-finite entries, take no part, nor
do those of another length than most have (of lengths that equally many have, the shorter). A null
vec_id is an id like any other, and repeated rows are rows of their own. A component along which the
vectors don't vary, beyond what rounding makes of zero, can't be scaled: its whitened values are null,
and identity_error leaves it out. The sign of a component is such that its largest entry is positive.
A deviation beyond a long is null. An empty table gives an empty table. Only the id and vector columns
are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

SCALE, OFFSET = 1024, 100_000
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors that take part, but for their length, as integers."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + OFFSET)
    return rows.filter(vector.isNotNull() & (F.size(vector) > 0) & ~bad).select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("x")
        lengths = vectors.value_lengths().to_numpy()
        flat = vectors.flatten().to_numpy()
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        for d in np.unique(lengths).tolist():
            at = starts[lengths == d]
            total = sums.setdefault(d, np.zeros(d + 1, dtype=np.int64))
            total[0] += len(at)
            total[1:] += flat[at[:, None] + np.arange(d)].sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int64()), pa.array(list(sums.values()), type=pa.list_(pa.int64()))], names=["d", "sums"])


def totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors have the length that most have, and the exact sums of their components. A task sends one row a length."""
    parts = bound_batches(vectors).select("x").mapInArrow(_summed, "d bigint, sums array<bigint>")
    entries = parts.select("d", F.posexplode("sums").alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v"))
    top = entries.filter("at = 0").orderBy(F.desc("v"), "d").limit(1).collect()
    if not top:
        return 0, np.zeros(0, dtype=np.int64)
    sums = entries.filter((F.col("d") == top[0].d) & (F.col("at") > 0)).orderBy("at").collect()
    return top[0].v, np.array([r.v for r in sums], dtype=np.int64)


def centred(x: Column, n: int, sums: np.ndarray) -> Column:
    """n * x - sums, an array of exact integers. Taken from the whole part of the mean, so that a product holds the spread, not the offset."""
    whole, rest = (F.array(*(F.lit(int(v)) for v in part)) for part in divmod(sums, n))
    return F.transform(x, lambda c, i: (c - F.get(whole, i)) * F.lit(n).cast("bigint") - F.get(rest, i))


def gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """The sums of products of the entries of an array column, by MLlib: one partial matrix a task, added up as a tree."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def projection(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, explained): scaled unit eigenvectors as columns, by falling eigenvalue, and their shares of the variance. Columns that can't be scaled are NaN."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    least = len(covariance) * np.finfo(float).eps * max(e[0], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > least, v / np.sqrt(np.maximum(e, 0)), np.nan), np.maximum(e, 0) / np.trace(covariance)


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of the first components."""
    spark = rows.sparkSession
    vectors = integers(rows, id_col, vector_col)
    n, sums = totals(vectors)
    if not n:
        return spark.createDataFrame([], RESULT)
    d = len(sums)
    named = F.coalesce("vec_id", F.lit(0)).cast("bigint").alias("id"), F.col("vec_id").isNull().alias("no_id")  # pandas has no integer column with nulls
    exact = vectors.filter(F.size("x") == d).select(*named, centred(F.col("x"), n, sums).alias("c"))
    divided = F.transform("c", lambda c: c / F.lit(float(n)))
    matrix, explained = projection(gramian(exact, divided) / n, components)
    sent = spark.sparkContext.broadcast(matrix)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c = np.stack(frame["c"]) if len(frame) else np.zeros((0, d), dtype=np.int64)
            # A square sum that a long may not hold is summed in Python's integers.
            near = (c.astype(float) ** 2).sum(axis=1) < 2**62
            deviation = [int(v) if ok else sum(int(x) ** 2 for x in r) for v, ok, r in zip((np.where(near[:, None], c, 0) ** 2).sum(axis=1), near, c)]
            w = (c / n) @ sent.value
            yield pd.DataFrame({"id": frame["id"], "no_id": frame["no_id"], "deviation": pd.array([v if v < 2**63 else None for v in deviation], dtype="Int64"), "w": list(w)})

    whitened = materialize(bound_batches(exact).mapInPandas(project, "id bigint, no_id boolean, deviation bigint, w array<double>"))
    good = np.flatnonzero(~np.isnan(matrix).any(axis=0))
    error = 0.0
    if len(good):
        used = F.array(*(F.get("w", F.lit(int(k))) for k in good))
        means = whitened.agg(*(F.avg(F.get("w", F.lit(int(k)))) for k in good)).first()
        around = F.zip_with(used, F.array(*map(F.lit, means)), lambda a, m: a - m)
        error = float(np.abs(gramian(whitened, around) / n - np.eye(len(good))).max())
    shares = F.array(*(F.lit(float(v)) for v in explained))
    each = whitened.select(F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "deviation", F.posexplode("w").alias("k", "v"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", F.when(~F.isnan("v"), F.col("v")).alias("whitened"), F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))

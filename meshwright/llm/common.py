"""What the operators share: table reading, training samples, small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import materialize

__all__ = ["SPACE_CHARS", "WORD", "add_columns", "ascii_lower", "crc_bucket", "join_hot", "labelled_sample", "materialize", "read"]

#: Rows that Python holds as objects at a time; a batch that Spark sends may have 10,000.
SLICE_ROWS = 1024
#: Bytes of a batch that goes to Python, in sessions that keep Spark's default of 64 MB. A writer doubles its
#: buffers as it fills them, so a batch takes three times its size for a moment, outside the heap.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: A key is hot if it has more than this share of the rows; fewer than one over it can be.
HOT_SHARE = 0.001

#: The white space that separates words in every contract of this package.
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast built-in, which then does the same."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """(doc_id, text, label): documents with an agreed label 0 or 1 for which keep holds, at most limit ids, a row each.

    Ids are taken in the order of their hash, so the sample is the same in each run; of several texts of
    an id the one whose hash is smallest. It bounds what a
    classifier is fitted on; nothing else is decided by it.
    """
    agreed = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(keep)
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .filter("label = most").select("doc_id", "label")
    )
    ids = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(ids), "doc_id").repartition(8, "doc_id")
    return materialize(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label"))


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after holding batches to BATCH_BYTES in its session, unless that has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING).rstrip("b") == str(_BATCH_DEFAULT):
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def add_columns(docs: DataFrame, added: list[T.StructField], column: str, compute: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """docs with columns added (in place of columns so named) that compute() makes of slices of one column.

    keep names the columns of docs that pass through (all, unless given). The column goes to Python once,
    whether it passes through or not.
    """
    fresh = [f.name for f in added]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in fresh]
    at = kept.index(column) if column in kept else len(kept)
    sent = docs.select(*kept) if at < len(kept) else docs.select(*kept, F.col(column).alias("__input"))
    n = len(kept)
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *compute(part.column(at))], names=[*kept, *fresh])
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return sent.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *added]))


def join_hot(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """rows joined with table (unique by key, with the number n of rows for each key), hot keys apart.

    Fewer than 1 / HOT_SHARE keys can hold more than HOT_SHARE of all rows, which bounds the table that is
    broadcast for them; rows of hot keys stay where they are. The others are shuffled. table is read twice.
    """
    hot = F.col(n) > max(1, int(total * HOT_SHARE))
    often = table.filter(hot).drop(n)
    rest = rows.join(F.broadcast(often.select(*key)), key, "left_anti").join(table.filter(~hot).drop(n), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)

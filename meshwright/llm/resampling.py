"""Importance resampling toward a target distribution, over hashed n-grams by CRC combination.

Each word's CRC-32 is computed once. The CRC of an n-gram follows from those of its words: appending
k bytes to a text multiplies its CRC by a 32 x 32 matrix over GF(2) that depends on k alone, and the
CRC of what was appended is added. Such matrices, one for each power of two of k and each as four
tables of 256 entries, move whole arrays of CRCs; no n-gram is ever put together as a string.

Two passes read the texts. The first counts features by bucket: a task sends its table of buckets, so
a frequent word weighs no more than a rare one. The second adds up a document's gains. Documents are
then range-partitioned by score, and a place is the number of rows of the parts before, plus that
within the part; no task holds more than a part.

Defined results: a null text, or one without words, has no features, weight 0, and is never drawn
where min_words is above 0. A null doc_id has the noise of an empty id and comes last among ties. Rows
that repeat a doc_id are documents of their own, with the same noise; rows equal in all these columns
take places next to each other, in any order. Null target texts have no features. Empty tables have no
features: all gains are then smoothed from 0, and nothing is drawn from an empty table of documents.
Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, bound_batches, materialize
from .mixing import before_each

#: Words are runs of lower-cased ASCII letters, digits and anything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a long text that are taken apart at a time.
PIECE = 1 << 20
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Rows of a part when documents are ranked; a part is a task.
PART_ROWS = 200_000
MOST_PARTS = 8192


def _tables(columns: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by its 32 columns, as four tables: of a value's bytes, the sums of columns."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, columns[8 * k + bit], 0).astype(np.uint32)
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@cache
def _shift_tables(power: int) -> np.ndarray:
    """The matrix that appends 2**power zero bytes to what a CRC is of: a byte's is eight shifts by one bit, each further one a square."""
    if power:
        half = _shift_tables(power - 1)
        return _tables(_times(half, _times(half, np.uint32(1) << np.arange(32, dtype=np.uint32))))
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = columns >> 1 ^ np.where(columns & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return _tables(columns)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after as many bytes as lengths say have been appended, before those bytes' own CRC is added."""
    out, power, rest = crcs.copy(), 0, lengths.copy()
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _times(_shift_tables(power), out[odd])
        rest >>= 1
        power += 1
    return out


_BLANK = np.uint32(zlib.crc32(b" "))


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, max_n: int) -> Iterator[np.ndarray]:
    """For n = 1 .. max_n the CRCs of all runs of n words joined by a blank, from those of the words and their lengths in bytes."""
    yield crcs
    if max_n > 1 and len(crcs) > 1:
        behind = shifted(np.full(len(crcs), _BLANK), lengths) ^ crcs  # of a blank and the word
        grams = crcs
        for n in range(2, min(max_n, len(crcs)) + 1):
            grams = shifted(grams[:-1], lengths[n - 1 :] + 1) ^ behind[n - 1 :]
            yield grams


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut where no word is."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def text_buckets(text: bytes | None, max_n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features) of each piece of a text. bytes.lower() touches ASCII alone.

    A piece but the first begins with the last max_n - 1 words before it, whose runs of their own have been told.
    """
    crcs, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for piece in _pieces((text or b"").lower()):
        words = _WORD.findall(piece)
        told = len(crcs)
        crcs = np.r_[crcs, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        if max_n > 1:
            lengths = np.r_[lengths, np.fromiter(map(len, words), np.int64, len(words))]
        # A run of n words is new if its last word is.
        new = [g[max(0, told - n) :] for n, g in enumerate(ngram_crcs(crcs, lengths, max_n))]
        yield len(words), np.concatenate(new) % np.uint32(buckets)
        keep = max(0, len(crcs) - max_n + 1)
        crcs, lengths = crcs[keep:], lengths[keep:]


def _counted(batches: Iterator[pa.RecordBatch], max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            for _, found in text_buckets(text.as_py(), max_n, buckets):
                counts += np.bincount(found, minlength=buckets)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall in each bucket: a table of fixed size."""
    sent = bound_batches(texts).filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary"))
    rows = sent.mapInArrow(partial(_counted, max_n=max_n, buckets=buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's smoothed log ratio of target to source, in thousandths, rounded down."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, max_n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), SLICE_ROWS):
            part = batch.slice(i, SLICE_ROWS)
            totals = np.zeros((part.num_rows, 3), dtype=np.int64)  # words, features, weight
            for row, text in zip(totals, part.column("text")):
                for n_words, found in text_buckets(text.as_py(), max_n, len(gain)):
                    row += n_words, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, totals.T.copy())], names=["doc_id", "n_words", "n_features", "weight"])
        pa.default_memory_pool().release_unused()


def gumbel(id_col: Column, seed: int) -> Column:
    """Noise of the Gumbel distribution in thousandths, rounded down, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], n_rows: int) -> DataFrame:
    """rows, written, with place: 1, 2, 3 .. in ascending order. Ranges of the order are parts, each of which a task sorts."""
    unique = materialize(rows).withColumn("_row", F.monotonically_increasing_id())  # tells rows apart that are equal in the order
    key = F.struct(*order, F.col("_row"))
    parts = max(1, min(MOST_PARTS, -(-n_rows // PART_ROWS)))
    dealt = materialize(unique.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    return before_each(dealt, F.lit(1), key, "place").withColumn("place", F.col("place") + 1).drop("part", "_row")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 1, buckets: int = 10_000,
             seed: int = 2024, min_words: int = 20, share: tuple[int, int] = (10, 100)) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per document, with the rank of those that are drawn.

    Of the documents with min_words words at least, the share with the highest scores is drawn: the
    weight with the noise added, so that it is a sample without replacement in proportion to importance.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    texts = bound_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    weighed = texts.mapInArrow(partial(_weighed, gain=gain, max_n=max_n), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    open_ = scored.filter(F.col("n_words") >= min_words)
    n = open_.count()
    drawn = share[0] * n // share[1]
    placed = ranked(open_, [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")], n)
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("bigint")
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", rank).drop("place").unionByName(rest)

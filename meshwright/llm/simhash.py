"""SimHash near-deduplication by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, so that of two fingerprints within three bits one half
differs by one bit at most. Each half is indexed exactly and with each of its bits as a wildcard (33
keys, 66 a fingerprint); equal keys meet, and the whole fingerprints are verified. Distinct
fingerprints are indexed, not documents, so exact copies cost nothing. A bucket yields a spanning
forest of its verified links, not its pairs. Buckets beyond a size are indexed again by the variants
of the two quarters of the other half; that bounds a bucket by 2**18 fingerprints.

Defined results: a text that is null or without words has fingerprint zero and is linked like any
other. A null doc_id is never the smallest; a component of null ids alone has a null component_id.
Repeated rows are documents of their own in one component. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_hot, materialize
from .components import components
from .line_dedup import KEY, keyed, row_key, with_row_key

MAX_BITS = 3
#: Members beyond which a bucket is indexed anew by the other half.
BUCKET_LIMIT = 4096
_BITS = np.array([1 << b for b in range(64)], dtype=np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text. bytes.lower() and bytes.split() touch ASCII alone."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return sign_bits(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype=np.uint64))


def sign_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; zero without any."""
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):  # sums of a slice fit memory whatever the text's length
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * bits > len(hashes)].sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k_text"), pa.array(fps.view(np.int64))], names=["doc_id", "k_text", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_text, fp): one row per document; k_text names its text within the id."""
    return bound_batches(docs).select(
        F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col))[1], F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(_fingerprints, "doc_id bigint, k_text bigint, fp bigint")


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (indexes) of a spanning forest under 'at most MAX_BITS apart', breadth first."""
    left, right, open_ = [], [], np.arange(1, len(fps))
    queue = [0]
    while True:
        while queue:
            at = queue.pop()
            near = np.bitwise_count(fps[open_] ^ fps[at]) <= MAX_BITS
            found = open_[near].tolist()
            if found:
                left += [at] * len(found)
                right += found
                queue += found
                open_ = open_[~near]
        if not len(open_):
            return left, right
        queue.append(int(open_[0]))
        open_ = open_[1:]


def _link(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, wild, fp), sorted by key: verified links (k2 null), or members of too large buckets."""

    def out(a, b, keys=None, wilds=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)),
             pa.array(keys, type=pa.int64()) if keys is not None else pa.nulls(n, pa.int64()),
             pa.array(wilds, type=pa.int32()) if wilds is not None else pa.nulls(n, pa.int32())],
            names=["a", "b", "key", "wild"],
        )

    none = np.zeros(0, dtype=np.uint64)
    rest_k1, rest_k2, rest_w, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), none
    large = None  # the key whose members go on to the next level, once it has passed the limit

    def emit(k1, k2, wild, fps):
        nonlocal large
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, np.int64)
        if not len(starts):
            return
        sizes = np.diff(np.r_[starts, len(k1)])
        wildcard = wild[starts] < 64
        bit = (fps >> np.where(wild < 64, wild, 0).astype(np.uint64)) & np.uint64(1)
        ones = np.add.reduceat(bit, starts)
        # Members that agree on the wildcard bit also meet in the exact bucket.
        useful = (sizes > 1) & (~wildcard | ((ones > 0) & (ones < sizes)))
        two = starts[useful & (sizes == 2)]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= MAX_BITS]
        if len(near):
            yield out(fps[near], fps[near + 1])
        left, right = [], []
        for s, n in zip(starts[useful & (sizes > 2)].tolist(), sizes[useful & (sizes > 2)].tolist()):
            if (k1[s], k2[s]) == large or n > limit:
                large = (k1[s], k2[s])
                yield out(fps[s : s + n], fps[s : s + n], k1[s : s + n], wild[s : s + n])
                continue
            a, b = _forest(fps[s : s + n])
            left += [s + x for x in a]
            right += [s + x for x in b]
        if left:
            yield out(fps[left], fps[right])

    for batch in batches:
        k1 = np.r_[rest_k1, batch.column("k1").to_numpy()]
        k2 = np.r_[rest_k2, batch.column("k2").to_numpy()]
        wild = np.r_[rest_w, batch.column("wild").to_numpy()]
        fps = np.r_[rest, batch.column("fp").to_numpy().view(np.uint64)]
        if not len(k1):
            continue
        differ = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))
        cut = int(differ[-1]) + 1 if len(differ) else 0  # the last bucket may go on in the next batch
        if large is not None and (k1[0], k2[0]) == large:  # more members of a bucket that has gone on
            n = int(np.flatnonzero(np.r_[(k1 != k1[0]) | (k2 != k2[0]), True])[0])
            yield out(fps[:n], fps[:n], k1[:n], wild[:n])
            k1, k2, wild, fps, cut = k1[n:], k2[n:], wild[n:], fps[n:], max(0, cut - n)
            if not len(k1):
                rest_k1, rest_k2, rest_w, rest = k1, k2, wild, fps
                continue
        yield from emit(k1[:cut], k2[:cut], wild[:cut], fps[:cut])
        rest_k1, rest_k2, rest_w, rest = k1[cut:], k2[cut:], wild[cut:], fps[cut:]
        if len(rest) > limit:
            large = (rest_k1[0], rest_k2[0])
            yield out(rest, rest, rest_k1, rest_w)
            rest_k1, rest_k2, rest_w, rest = rest_k1[:0], rest_k2[:0], rest_w[:0], none
    yield from emit(rest_k1, rest_k2, rest_w, rest)


LINKS = "a bigint, b bigint, key bigint, wild int"


def _first_level(fps: DataFrame) -> DataFrame:
    """66 rows a fingerprint: half, wildcard (32: none) and the half without that bit, in k1; wild is its bit, 64 for none."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v"))
    half, place = F.floor(F.col("v") / 33), F.col("v") % 33
    bits = F.shiftrightunsigned("fp", 0).bitwiseAND(F.lit(0xFFFFFFFF))
    upper = F.shiftrightunsigned("fp", 32)
    segment = F.when(half == 0, bits).otherwise(upper)
    masked = F.when(place == 32, segment).otherwise(segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(v % 33 as int))"))))
    return v.select(
        (F.shiftleft(F.col("v").cast("bigint"), 32).bitwiseOR(masked)).alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.when(place == 32, 64).otherwise(half * 32 + place).cast("int").alias("wild"), "fp",
    )


def _second_level(members: DataFrame) -> DataFrame:
    """34 rows a member of a large bucket: its key in k1, a quarter of the other half with its wildcard in k2.

    The bit of the first wildcard no longer matters: any two members may be linked here.
    """
    v = members.select(F.col("a").alias("fp"), F.col("key").alias("k1"), F.explode(F.sequence(F.lit(0), F.lit(33))).alias("v"))
    # Keys of the lower half have v < 33: their other half is the upper one.
    other = F.when(F.shiftrightunsigned("k1", 32) < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarter, place = F.floor(F.col("v") / 17), F.col("v") % 17
    segment = F.when(quarter == 0, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))
    masked = F.when(place == 16, segment).otherwise(segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(v % 17 as int))"))))
    return v.select("k1", F.shiftleft(F.col("v").cast("bigint"), 16).bitwiseOR(masked).alias("k2"), F.lit(64).alias("wild"), "fp")


def _meet(index: DataFrame, limit: int) -> DataFrame:
    dealt = index.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return dealt.mapInArrow(partial(_link, limit=limit), LINKS)


def fingerprint_links(fps: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): verified links that connect whatever distinct fingerprints within MAX_BITS bits connect."""
    first = materialize(_meet(_first_level(fps), limit))
    second = _meet(_second_level(first.filter("key is not null")), 1 << 18)
    return first.filter("key is null").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, k_text, fp, root, component_id): one row per document.

    root is the smallest fingerprint of the component and names it; component_id is its smallest id.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    total = prints.count()
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), total)
    roots = components(fingerprint_links(distinct.select("fp"), limit), total)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(named, "root").select("fp", "root", "component_id", "n"), total)
    return join_hot(prints, classes, ["fp"], "n", total).select("doc_id", "k_text", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id (then text hash); a null id if it has no other."""
    found = near_duplicates(docs, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k_text")).alias("s"))
    kept = first.select(F.coalesce("s.doc_id", F.lit(0).cast("bigint")).alias("k_id"), F.col("s.k_text").alias("k_text"))
    rows = with_row_key(docs, id_col, text_col).join(keyed(kept.distinct()), KEY, "left_semi")
    return rows.dropDuplicates(KEY).select(*docs.columns)

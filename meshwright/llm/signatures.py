"""Near copies by similarity: SimHash fingerprints, and the same deletion-variant index over wider ones for what these miss.

Each text has a SimHash fingerprint of 64 sign bits over its five-word shingles. Fingerprints are
indexed, met and verified to be within three bits by simhash.py; texts of such fingerprints are
candidates. Of texts whose sets of shingles have a Jaccard similarity of 0.8, however, ten of 64 sign
bits differ on average. For one of the segments to differ by at most one bit, these would have to be of
seven bits, and its buckets a 64th of all texts. So a second fingerprint has symbols in place of bits: the
least value of a hash over the shingles, which two texts share with a probability equal to their
similarity. It is cut into SEGMENTS of SIZE symbols and indexed with one symbol deleted at a time; a
segment of two texts of similarity s meets if it differs by one symbol at most, so a pair is missed
with probability (1 - s**5 - 5 * s**4 * (1 - s))**6: 0.0003 at 0.8, 0.00001 at 0.85. Candidates of both
are verified by the exact similarity.

A bucket of symbols yields minimum spanning forests by the share of equal symbols, not its pairs, and each edge is
verified by the exact similarity. Edges run along the most similar pairs, so what a failing edge
separates would be joined by no other edge of the bucket but one that looks less similar. Shares are
estimates; a forest for each of PARTS sets of symbols, which err independently, makes up for that.
Buckets beyond a size are cut into blocks, and each pair of blocks is searched; the union of their
forests holds the forest of the bucket.

Defined results: texts are compared by their words, white space and A-Z aside. A text of up to five
words is one shingle; a text that is null or without words is a copy of any other such. Repeated rows
are copies. A null doc_id is never the smallest. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import discard
from .common import add_columns, bound_batches, join_hot, materialize
from .components import components
from .line_dedup import KEY, keyed, row_key, with_row_key
from .simhash import fingerprint_links, sign_bits

WIDTH = 5
#: The least similarity, as a fraction of integers.
LEAST = (4, 5)
SEGMENTS, SIZE = 6, 5
#: Symbols of a sketch, and the parts of it by each of which a forest is made; those beyond the segments' serve the estimates alone.
SYMBOLS, PARTS = 192, 3
PART = SYMBOLS // PARTS
#: Equal symbols of a part below which a pair isn't verified: at a similarity of 0.8, 51 are expected and the deviation is 3.2.
LEAST_EQUAL = 36
BLOCK = 4096
#: Of a text's keys and sketch.
ROW_BYTES = 8 * SEGMENTS * SIZE + 2 * SYMBOLS + 60

_rng = np.random.default_rng(64)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower() and bytes.split() touch ASCII alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if n == 1 else width, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = _mixed(out * _P + hashed[k : k + n])
    return np.unique(out)


def symbols(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SYMBOLS hash functions. Slices bound the memory that a long text takes."""
    out = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def deletion_keys(values: np.ndarray) -> np.ndarray:
    """A key for each segment and deleted symbol."""
    keys = np.empty((SEGMENTS, SIZE), dtype=np.uint64)
    parts = _mixed(values[: SEGMENTS * SIZE]).reshape(SEGMENTS, SIZE)
    for gone in range(SIZE):
        h = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SIZE) + np.uint64(gone + 1)
        for k in range(SIZE):
            if k != gone:
                h = _mixed(h * _P + parts[:, k])
        keys[:, gone] = h
    return keys.ravel()


def _signed(texts: pa.Array) -> list[pa.Array]:
    nodes, keys, sketches, prints = [], [], [], []
    for t in texts:
        text = t.as_py()
        nodes.append(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split())))
        hashes = shingles(text)
        values = symbols(hashes)
        keys.append(deletion_keys(values).view(np.int64) if len(hashes) else np.zeros(0, dtype=np.int64))
        sketches.append((_mixed(values) >> np.uint64(48)).astype(np.uint16).tobytes())
        prints.append(sign_bits(hashes))
    as_longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
    return [as_longs(nodes), pa.array(keys, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary()), as_longs(prints)]


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col))[1], F.col(text_col).cast("binary").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_text, node, keys, sketch, fp): one row per document; texts of equal words have one node."""
    added = [T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("fp", T.LongType())]
    return add_columns(_text_rows(docs, id_col, text_col), added, "text", _signed, ["doc_id", "k_text"])


def forest(sketches: np.ndarray, least: int = LEAST_EQUAL) -> tuple[list[int], list[int]]:
    """Edges (indexes) of a minimum spanning forest: along the most equal symbols, none with fewer than least."""
    n = len(sketches)
    left, right = [], []
    best, link = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
    open_ = np.arange(1, n)
    at = 0
    while len(open_):
        equal = (sketches[open_] == sketches[at]).sum(axis=1, dtype=np.int32)
        closer = equal > best[open_]
        best[open_[closer]], link[open_[closer]] = equal[closer], at
        k = int(best[open_].argmax())
        at = int(open_[k])
        if best[at] >= least:
            left.append(int(link[at]))
            right.append(at)
        open_ = np.delete(open_, k)
    return left, right


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): edges of the forest of each bucket; rows are sorted by bucket."""

    def out(a, b):
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rest_key, rest_node, rest_sketch = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, SYMBOLS), np.uint16)

    def edges(key, node, sketch):
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= PARTS * LEAST_EQUAL] if len(two) else two
        a, b = [node[near]], [node[near + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for p in range(0, SYMBOLS, PART):
                x, y = forest(sketch[s : s + n, p : p + PART])
                a.append(node[s : s + n][x])
                b.append(node[s : s + n][y])
        return out(a, b)

    for batch in batches:
        key = np.stack([batch.column("key").to_numpy(), batch.column("pair").to_numpy()], axis=1)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
        key, node, sketch = np.concatenate([rest_key, key]), np.r_[rest_node, batch.column("node").to_numpy()], np.concatenate([rest_sketch, sketch])
        if not len(key):
            continue
        differ = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(differ[-1]) + 1 if len(differ) else 0  # the last bucket may go on in the next batch; it has two blocks at most
        yield edges(key[:cut], node[:cut], sketch[:cut])
        rest_key, rest_node, rest_sketch = key[cut:], node[cut:], sketch[cut:]
    yield edges(rest_key, rest_node, rest_sketch)


def candidate_edges(texts: DataFrame, n_texts: int, block: int = BLOCK) -> DataFrame:
    """(a, b): forest edges of all buckets of n_texts texts (node, keys, sketch; nodes unique)."""
    rows = texts.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("members", F.col("n"))
    # A bucket of up to block texts is one pair (0, 0); a larger one has a row for each pair of blocks that the text's own is in.
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), blocks - 1))).alias("other")
    dealt = join_hot(rows, shared, ["key"], "n", SEGMENTS * SIZE * n_texts).select("key", "node", own.alias("own"), blocks.alias("blocks"), others)
    # In a bucket of several blocks, a block meets itself in its pairs with the others.
    useful = (F.col("blocks") == 1) | (F.col("own") != F.col("other"))
    pair = F.least("own", "other").cast("bigint") * (1 << 31) + F.greatest("own", "other")
    dealt = dealt.filter(useful).select("key", "node", pair.alias("pair")).join(texts.select("node", "sketch"), "node")
    met = bound_batches(dealt).repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return met.select("key", "pair", "node", "sketch").mapInArrow(_forests, "a bigint, b bigint").distinct()


def fingerprint_edges(texts: DataFrame, n_texts: int) -> DataFrame:
    """(a, b): edges between n_texts texts (node, fp) that connect what fingerprints within three bits connect.

    The texts of a fingerprint are linked to the smallest of them, and these along the links of fingerprints.
    """
    prints = materialize(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), n_texts)
    near = fingerprint_links(prints.select("fp")).distinct()
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    same = join_hot(texts.select("node", "fp"), prints.filter("n > 1"), ["fp"], "n", n_texts).filter("node <> first")
    return near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b")))


def _sets(texts: pa.Array) -> list[pa.Array]:
    return [pa.array([shingles(t.as_py()).tobytes() for t in texts], type=pa.binary())]


def similar(x: bytes, y: bytes, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sets of hashes have the least similarity."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    p, q = least
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    return (p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b))


def _verified(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(x.as_py(), y.as_py(), least) for x, y in zip(batch.column("x"), batch.column("y"))]
        kept = batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))
        yield kept


def links(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between texts (node, first, keys, sketch, fp), whose words are those of first's row of docs."""
    rows = texts.count()
    both = fingerprint_edges(texts, rows).unionByName(candidate_edges(texts, rows, block))
    edges = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows)
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    wanted = texts.join(ends, "node").select("node", F.coalesce("first.doc_id", F.lit(0).cast("bigint")).alias("k_id"), F.col("first.k_text").alias("k_text"))
    held = with_row_key(docs.select(id_col, text_col), id_col, text_col).join(keyed(wanted), KEY).select("node", F.col(text_col).cast("binary").alias("text"))
    sets = materialize(add_columns(held, [T.StructField("set", T.BinaryType())], "text", _sets, ["node"]).dropDuplicates(["node"]), rows, ROW_BYTES)
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.mapInArrow(partial(_verified, least=least), "a bigint, b bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies: that of its smallest id (then text hash); a null id if it has no other."""
    signed = materialize(signatures(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k_text")
    rows = signed.count()
    texts = materialize(signed.groupBy("node").agg(F.min(order).alias("first"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"), F.any_value("fp").alias("fp")), rows, ROW_BYTES)
    discard(signed)
    roots = components(links(docs, texts, id_col, text_col, least, block), rows)
    rooted = texts.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("s"))
    kept = first.select(F.coalesce("s.doc_id", F.lit(0).cast("bigint")).alias("k_id"), F.col("s.k_text").alias("k_text"))
    named = with_row_key(docs, id_col, text_col).join(keyed(kept), KEY, "left_semi")
    return named.dropDuplicates(KEY).select(*docs.columns)

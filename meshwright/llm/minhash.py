"""Near copies by MinHash with one circulant permutation, bands, and exact verification.

A shingle's hash falls in a universe of 2**20 places. A first permutation scatters the places; all
coordinates of a signature come of a second one, shifted by one place from coordinate to coordinate:
coordinate k is the least value of the second permutation at (first(place) + k). Written twice in a
row, the second permutation holds a place's values for all coordinates next to each other.

A signature is cut into BANDS of ROWS coordinates. Texts that agree on a band meet, and whether they
are linked is told by their full sets alone: a pair is missed if it meets in no band, which at the
least similarity, 0.8, has probability (1 - 0.8**5)**40, about one in eight million.

A bucket isn't expanded to its pairs. Its texts are compared with one of them, a pivot: first the one
of the least hash, then the one with most links so far. What these links join is one component;
almost all buckets then hold one alone. In the others, each text outside the largest component is held
against all texts of other components at once, by an index of the bucket's shingles, and only the links
that join two components leave the task. Buckets that are too large for a task are cut into blocks, and
each pair of blocks is searched.

Defined results: sets are of distinct shingles of WIDTH words, A-Z lower-cased; of fewer words the
whole sequence is the one shingle. A text that is null or without words has an empty set and is linked
with nothing; it is kept. Texts of equal sets are linked. A null doc_id is never the smallest; a
component of null ids alone has a null component_id, and all its rows are kept. Repeated rows are
documents of their own in one component. An empty table gives an empty table. Only the id and text
columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bound_batches, join_hot, materialize
from .components import components
from .line_dedup import KEY, keyed, row_key, with_row_key
from .signatures import shingles, similar

WIDTH = 2
#: The least similarity, as a fraction of integers.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
UNIVERSE_BITS = 20
#: Texts of a block, and bytes of their sets; a task holds two blocks.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Postings that are counted at a time.
SLICE = 1 << 22
#: Of a text's keys.
ROW_BYTES = 8 * BANDS + 60

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def permutations(bits: int = UNIVERSE_BITS, coordinates: int = COORDINATES, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view of the second by place: its values there and at the following places, one for each coordinate."""
    rng = np.random.default_rng(seed)
    first, second = (rng.permutation(1 << bits).astype(np.uint32) for _ in range(2))
    return first, np.lib.stride_tricks.sliding_window_view(np.r_[second, second[: coordinates - 1]], coordinates)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate over a set of hashes. Slices bound the memory that a long text takes."""
    first, windows = permutations()
    out = np.full(COORDINATES, np.uint32(2**32 - 1))
    places = first[hashes >> np.uint64(64 - UNIVERSE_BITS)]
    for i in range(0, len(places), 2048):
        np.minimum(out, windows[places[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in values.astype(np.uint64).reshape(BANDS, ROWS).T:
        h = (h ^ part) * _P
        h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def _signed(texts: pa.Array, width: int) -> list[pa.Array]:
    nodes, sizes, keys = [], [], []
    for t in texts:
        hashes = shingles(t.as_py(), width)
        sizes.append(len(hashes))
        full = len(hashes) > 0
        nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if full else None)
        keys.append(band_keys(signature(hashes)).view(np.int64) if full else None)
    return [pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, k_text, node, n_shingles, keys): one row per document; texts of equal sets have one node, empty ones none."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col))[1], F.col(text_col).cast("binary").alias("text"))
    added = [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return add_columns(rows, added, "text", partial(_signed, width=width), ["doc_id", "k_text"])


def _verified(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(x.as_py(), y.as_py(), least) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))


def verified(edges: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): those of the distinct pairs whose sets (node, set) are similar enough."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return bound_batches(both).mapInArrow(partial(_verified, least=least), "a bigint, b bigint")


def pivot_pairs(members: DataFrame, pivots: DataFrame, total: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): each member (key, node, n) with its bucket's pivot (key, pivot, pivot_n, members), unless their sizes tell that they can't be linked."""
    p, q = least
    met = join_hot(members, pivots, ["key"], "members", total).filter(F.col("node") != F.col("pivot"))
    near = met.filter(q * F.least("n", "pivot_n") >= p * F.greatest("n", "pivot_n"))
    return near.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _joining(roots: np.ndarray, sets: list[np.ndarray], least: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links (indexes) that join different roots, enough to join all that any pair of similar sets would."""
    p, q = least
    names, part = np.unique(roots, return_inverse=True)
    if len(names) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]  # the sets that hold a value stand together
    first = np.r_[True, values[order][1:] != values[order][:-1]]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, len(values)])
    group = np.empty(len(values), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    above = list(range(len(names)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i in np.flatnonzero(part != np.bincount(part).argmax()):
        found = group[ends[i] - sizes[i] : ends[i]]
        found = found[lengths[found] > 1]
        shared = np.zeros(len(sets), dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(lengths[found]), np.arange(SLICE, lengths[found].sum() + SLICE, SLICE), side="right")
        for some in np.split(found, cuts):
            n = lengths[some]
            at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(holder[at], minlength=len(sets))
        for j in np.flatnonzero(((p + q) * shared >= p * (sizes + sizes[i])) & (part != part[i])).tolist():
            a, b = top(part[i]), top(part[j])
            if a != b:
                above[a] = b
                yield int(i), j


def _between(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(a, b): links between different roots of a bucket; rows are sorted by bucket and have at most two blocks each."""
    names = ("key", "pair", "node", "root")
    rest = [np.zeros(0, np.int64) for _ in names]
    rest_sets: list[np.ndarray] = []

    def links(columns, sets):
        key, pair, node, root = columns
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]) if len(key) else np.zeros(0, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            found = node[s:e][np.array(list(_joining(root[s:e], sets[s:e], least)), dtype=np.int64).reshape(-1, 2)]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    for batch in batches:
        columns = [np.r_[r, batch.column(c).to_numpy()] for r, c in zip(rest, names)]
        sets = rest_sets + [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column("set")]
        if not sets:
            continue
        differ = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = int(differ[-1]) + 1 if len(differ) else 0  # the last bucket may go on in the next batch
        yield from links([c[:cut] for c in columns], sets[:cut])
        rest, rest_sets = [c[cut:] for c in columns], sets[cut:]
    yield from links(rest, rest_sets)


def _labelled(members: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """members of buckets in which more than one root is left, with root: the component of links that a node is in."""
    roots = components(links, rows)
    rooted = members.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return rooted.join(mixed, "key", "left_semi")


def links(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between texts (node, first, n, keys), enough to join what similar pairs join."""
    rows = texts.count()
    every = texts.select("node", "n", F.explode("keys").alias("key"))
    order = F.struct("node", "n")
    pivots = every.groupBy("key").agg(F.min(order).alias("p"), F.count("*").alias("members")).filter("members > 1").select("key", "members", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    pivots = materialize(pivots, BANDS * rows, 32)
    # Buckets of one text are gone from here on.
    members = materialize(join_hot(every, pivots.select("key", F.col("members").alias("_n")), ["key"], "_n", BANDS * rows), BANDS * rows, 24)
    wanted = texts.join(members.select("node").distinct(), "node").select("node", F.coalesce("first.doc_id", F.lit(0).cast("bigint")).alias("k_id"), F.col("first.k_text").alias("k_text"))
    held = with_row_key(docs.select(id_col, text_col), id_col, text_col).join(keyed(wanted), KEY).select("node", F.col(text_col).cast("binary").alias("text"))
    hashed = add_columns(held, [T.StructField("set", T.BinaryType())], "text", lambda t: [pa.array([shingles(x.as_py(), width).tobytes() for x in t], type=pa.binary())], ["node"])
    sets = materialize(hashed.dropDuplicates(["node"]))
    total = members.count()
    found = materialize(verified(pivot_pairs(members, pivots, total, least), sets, least), rows)

    # Once more, with the text that has most links so far: of a family of copies the one that they are copies of.
    mixed = materialize(_labelled(members, found, rows), total, 32)
    degree = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    linked = mixed.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = linked.groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("p"), F.count("*").alias("members")).select("key", "members", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    again = pivot_pairs(mixed.select("key", "node", "n"), materialize(best, total, 32), total, least).join(found, ["a", "b"], "left_anti")
    found = materialize(found.unionByName(verified(again, sets, least)), rows)

    # What is left: texts of different components that share a bucket.
    left = materialize(_labelled(mixed.drop("root"), found, rows), total, 32)
    most = F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    blocks = materialize(left.groupBy("key").agg(F.count("*").alias("members"), most.alias("blocks")), total, 16)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = join_hot(left, blocks, ["key"], "members", total)
    dealt = dealt.select("key", "node", "root", own.alias("own"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # In a bucket of several blocks, a block meets itself in its pairs with the others.
    useful = (F.col("blocks") == 1) | (F.col("own") != F.col("other"))
    pair = F.least("own", "other").cast("bigint") * (1 << 31) + F.greatest("own", "other")
    dealt = dealt.filter(useful).select("key", pair.alias("pair"), "node", "root").join(sets, "node")
    met = bound_batches(dealt).repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return found.unionByName(met.select("key", "pair", "node", "root", "set").mapInArrow(partial(_between, least=least), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, k_text, n_shingles, node, component_id, kept): one row per document; component_id is the smallest id of its component."""
    signed = materialize(signatures(docs, id_col, text_col, width))
    rows = signed.count()
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "k_text")
    full = signed.filter("node is not null")
    texts = materialize(full.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("n_docs"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys")), rows, ROW_BYTES)
    roots = components(links(docs, texts, id_col, text_col, width, least, block), rows)
    rooted = texts.select("node", "first", "n_docs").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    classes = materialize(rooted.join(named, "root").select("node", "component_id", "n_docs"), rows)
    placed = join_hot(full, classes, ["node"], "n_docs", rows).select("doc_id", "k_text", "n_shingles", "node", "component_id")
    empty = signed.filter("node is null").select("doc_id", "k_text", "n_shingles", "node", F.col("doc_id").alias("component_id"))
    return placed.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

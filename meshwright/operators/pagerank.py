"""PageRank by power iteration, of each repository by itself: parts of its nodes send each other sums of shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..tables import discard, distinct_by, materialize, materialize_by
from .traverse import ID, scoped

#: Sources with more than this share of the links are fewer than one over it; their links lie with their targets.
HOT_SHARE = 0.001
#: Rows of a table that is broadcast, some 60 bytes each; a larger one is joined by a shuffle.
FEW_ROWS = 500_000
#: Links that one task ranks by itself: some 100 MB. A round over parts costs more than all rounds over these.
LOCAL_LINKS = 500_000
#: Cells of a repository's nodes to a part, where nothing is known of which are near each other.
CELLS_A_PART = 64
#: Bytes of messages that a task holds before it hands them on.
BATCH_BYTES = 16 << 20

PART = ["repo_id", "part"]
#: Where rows of a part come from, besides the parts that link to it: its own sources, links of hot sources, its hot nodes.
OWN, HOT_LINKS, HOT_NODES = -3, -2, -1
_DEALT = "repo_id string, part int, origin int, ids array<{}>, degree binary, sent binary, starts binary, cuts binary"
_PART = "repo_id string, part int, nodes int, ids array<{}>, degree binary, sent binary, starts binary, cuts binary, got binary, hot binary, hot_sent binary, hot_got binary"
_MESSAGE = "repo_id string, part int, origin int, sums binary, hot binary, loose double, moved double"
_RANKS = "repo_id string, part int, parts int, n long, rank binary, moved double, done boolean"


def _ranks(links: pd.DataFrame, damping: float, max_iterations: int, tolerance: float | None) -> pd.DataFrame:
    """(repo_id, node_id, rank) of links that one task holds."""
    out = []
    for repo, mine in links.groupby("repo_id", sort=False):
        ids, at = np.unique(np.concatenate([mine["src_id"], mine["dst_id"]]).astype(str), return_inverse=True)
        n, src, dst = len(ids), at[: len(mine)], at[len(mine) :]
        degree = np.bincount(src, minlength=n)
        rank = np.full(n, 1 / n)
        for _ in range(max_iterations):
            got = np.bincount(dst, weights=(rank / np.maximum(1, degree))[src], minlength=n)
            before, rank = rank, (1 - damping) / n + damping * (got + rank[degree == 0].sum() / n)
            if tolerance is not None and np.abs(rank - before).sum() < n * tolerance:
                break
        out.append(pd.DataFrame({"repo_id": repo, "node_id": ids, "rank": rank}))
    return pd.concat(out)


def _codes(ids) -> tuple[np.ndarray, pa.Array]:
    """Numbers from 0 in the order of first appearance, and what they stand for; null is a value of its own."""
    found = pc.dictionary_encode(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _once(numbers: np.ndarray) -> np.ndarray:
    """numbers from 0 sorted, each once; faster than np.unique, which hashes them first."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) != 0]


def _pieces(t: pa.Table) -> Iterator[tuple[str, int, pa.Table]]:
    """The rows of each part."""
    (repo, repos), part = _codes(t["repo_id"]), t["part"].to_numpy()
    key = repo * (int(part.max()) + 1) + part
    if key.min() != key.max():
        order = np.argsort(key, kind="stable")
        t, key, repo, part = t.take(order), key[order], repo[order], part[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    for a, b in zip(at, [*at[1:], len(key)]):
        yield repos[repo[a]].as_py(), int(part[a]), t.slice(a, b - a)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """rows in which ids are Arrow arrays."""
    columns = []
    for field, values in zip(schema, zip(*rows)):
        if pa.types.is_list(field.type):
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.concat_arrays(values)))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schema(text: str, kind: pa.DataType | None = None) -> pa.Schema:
    """The Arrow schema of a row text; ids are lists of kind."""
    simple = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, simple.get(t) or pa.list_(kind)) for name, t in (c.split(" ", 1) for c in text.split(", "))])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links (repo_id, part, src_id, dst_id, dst_part[, hot]) of a part, each once: its sources, sorted by target, and for each part the targets there."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    schema = _schema(_DEALT, t.schema.field("src_id").type)
    for repo, part, mine in _pieces(t):
        rows = []
        if "hot" in mine.column_names:
            far = mine.filter(pc.is_valid(mine["hot"]))
            mine = mine.filter(pc.is_null(mine["hot"]))
            if len(far):
                d, ids = _codes(far["dst_id"])
                pairs = _once(far["hot"].to_numpy().astype(np.int64) * len(ids) + d)
                rows.append((repo, part, HOT_LINKS, ids, None, (pairs // len(ids)).astype(np.int32).tobytes(), (pairs % len(ids)).astype(np.int32).tobytes(), None))
        if len(mine):
            (s, sources), (d, targets) = _codes(mine["src_id"]), _codes(mine["dst_id"])
            home = np.empty(len(targets), np.int64)
            home[d] = mine["dst_part"].to_numpy()
            order = np.argsort(home, kind="stable")  # targets by part
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            pairs = _once(place[d] * len(sources) + s)
            to, sent = np.divmod(pairs, len(sources))
            degree = np.bincount(sent, minlength=len(sources))
            starts, cuts = np.flatnonzero(np.diff(to, prepend=-1)), np.bincount(home)
            rows.append((repo, part, OWN, sources, degree.tobytes(), sent.astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), cuts.tobytes()))
            ids, ends = targets.take(order), np.cumsum(cuts)
            rows += [(repo, int(j), part, ids.slice(ends[j] - cuts[j], cuts[j]), None, None, None, None) for j in np.flatnonzero(cuts)]
        yield _table(rows, schema)


def _hot_nodes(t: pa.Table) -> pa.Table:
    """The hot nodes of a part in the order of their numbers."""
    t = t.sort_by("hot")
    row = (t["repo_id"][0].as_py(), t["part"][0].as_py(), HOT_NODES, t["src_id"].combine_chunks(), t["degree"].to_numpy().astype(np.int64).tobytes(), None, None, None)
    return pa.Table.from_batches([_table([row], _schema(_DEALT, t.schema.field("src_id").type))])


def _numbered(t: pa.Table) -> pa.Table:
    """A part: its nodes, numbered, its own sources first; what it sends; and to which nodes what it gets goes, by origin."""
    t = t.sort_by("origin").combine_chunks()
    lists = t["ids"].combine_chunks()
    codes, ids = _codes(lists.flatten())
    n, ends = len(ids), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    nothing = np.flatnonzero(pc.is_null(ids).to_numpy(zero_copy_only=False))
    to = np.where(np.isin(codes, nothing), n, codes) if len(nothing) else codes  # as in SQL, no rank goes to null, nor comes from it
    degree, got = np.zeros(n, np.int64), []
    sent = starts = cuts = hot = hot_sent = hot_got = b""
    for row, origin in enumerate(t["origin"].to_pylist()):
        mine, field = slice(ends[row - 1] if row else 0, ends[row]), lambda name, row=row: t[name][row].as_py()
        if origin >= 0:
            got.append(to[mine])
        elif origin == HOT_LINKS:
            hot_sent, hot_got = field("sent"), to[mine][np.frombuffer(field("starts"), np.int32)].astype(np.int32).tobytes()
        else:
            degree[codes[mine]] = np.frombuffer(field("degree"), np.int64)
            if origin == OWN:
                sent, starts, cuts = field("sent"), field("starts"), field("cuts")
            else:
                hot = codes[mine].astype(np.int32).tobytes()
    degree[nothing] = 0
    got = np.concatenate(got).astype(np.int32).tobytes() if got else b""
    row = (t["repo_id"][0].as_py(), t["part"][0].as_py(), n, ids, degree.tobytes(), sent, starts, cuts, got, hot, hot_sent, hot_got)
    return pa.Table.from_batches([_table([row], _schema(_PART, ids.type))])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part sends to all parts of its repository: sums of shares by target there, shares of its hot nodes, its loose mass, and how far it moved."""
    schema, rows, size = _schema(_MESSAGE), [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            p = {name: batch[name][i].as_py() for name in batch.schema.names}
            degree = np.frombuffer(p["degree"], np.int64)
            rank = np.full(p["nodes"], 1 / p["n"]) if p["rank"] is None else np.frombuffer(p["rank"])
            share = np.where(degree > 0, rank / np.maximum(1, degree), 0)
            starts = np.frombuffer(p["starts"], np.int32)
            sums = np.add.reduceat(share[np.frombuffer(p["sent"], np.int32)], starts) if len(starts) else np.empty(0)
            ends = np.zeros(p["parts"] + 1, np.int64)
            cuts = np.cumsum(np.frombuffer(p["cuts"], np.int64))
            ends[1 : len(cuts) + 1], ends[len(cuts) + 1 :] = cuts, len(sums)
            hot, loose = share[np.frombuffer(p["hot"], np.int32)].tobytes(), float(rank[degree == 0].sum())
            rows += [(p["repo_id"], j, p["part"], sums[ends[j] : ends[j + 1]].tobytes(), hot, loose, p["moved"]) for j in range(p["parts"])]
            size += sums.nbytes + p["parts"] * (100 + len(hot))
            if size > BATCH_BYTES:
                yield _table(rows, schema)
                rows, size = [], 0
    if rows:
        yield _table(rows, schema)


def _received(damping: float, tolerance: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A round of a part: its new ranks from its old ones and what all parts of its repository sent."""

    def run(own: pa.Table, messages: pa.Table) -> pa.Table:
        schema = _schema(_RANKS)
        if not len(own):
            return schema.empty_table()  # no node is dealt to this part
        p = {name: own[name][0].as_py() for name in own.column_names}
        messages = messages.take(pc.sort_indices(messages["origin"]))
        joined = lambda name: np.frombuffer(b"".join(messages[name].to_pylist()))
        n, nodes = p["n"], p["nodes"]
        got = np.bincount(np.frombuffer(p["got"], np.int32), weights=joined("sums"), minlength=nodes + 1)
        if p["hot_sent"]:
            got += np.bincount(np.frombuffer(p["hot_got"], np.int32), weights=joined("hot")[np.frombuffer(p["hot_sent"], np.int32)], minlength=nodes + 1)
        rank = np.full(nodes, 1 / n) if p["rank"] is None else np.frombuffer(p["rank"])
        done = tolerance is not None and sum(messages["moved"].to_pylist()) < n * tolerance
        fresh = rank if done else (1 - damping) / n + damping * (got[:nodes] + sum(messages["loose"].to_pylist()) / n)
        row = (p["repo_id"], p["part"], p["parts"], n, fresh.tobytes(), float(np.abs(fresh - rank).sum()), done)
        return pa.Table.from_batches([_table([row], schema)])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo_id, node_id, rank) of parts."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch["ids"][i].values
            repo = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(ids), np.int32)), pa.array([batch["repo_id"][i].as_py()], pa.string())).cast(pa.string())
            rank = batch["rank"][i].as_py()
            rank = np.full(len(ids), 1 / batch["n"][i].as_py()) if rank is None else np.frombuffer(rank)
            yield pa.RecordBatch.from_arrays([repo, ids, pa.array(rank)], ["repo_id", "node_id", "rank"])


@contextmanager
def _batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Rows of a few numbers are cut to batches by their number alone: a look at a batch's bytes after each row takes twice the time of writing it."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_ROWS else df


def _parts(links: DataFrame, about: int, near: Callable[[Column], Column] | None) -> tuple[DataFrame | None, DataFrame | None]:
    """The parts of links (repo_id, src_id, dst_id), about so many, written by part; and (repo_id, parts). None if there are no links."""
    kind = links.schema["src_id"].dataType.simpleString()
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about // tables.ROWS_A_BUCKET))
    by_hash = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS_A_PART * tasks))
    cell = lambda end: F.coalesce((near or by_hash)(F.col(f"{end}_id")).cast("long"), F.lit(0)).alias(f"{end}_cell")
    ends = links.select("repo_id", F.explode(F.array(*(F.struct(cell(end).alias("cell"), F.lit(out).alias("out")) for end, out in (("src", 1), ("dst", 0))))).alias("end"))
    cells = materialize(ends.groupBy("repo_id", "end.cell").agg(F.count("*").alias("n"), F.sum("end.out").alias("out")))
    many, count = cells.agg(F.count("*"), F.sum("out")).first()
    if not count:
        return None, None
    size = -(-2 * count // tasks)
    before = F.sum("n").over(Window.partitionBy("repo_id").orderBy("cell")) - F.col("n")
    key = lambda c: F.xxhash64("repo_id", c)  # noqa: E731  # cells of the same key share the place of the last of them
    keyed = cells.select("repo_id", key("cell").alias("key"), F.floor(before / size).cast("int").alias("first"), F.ceil(F.col("n") / size).cast("int").alias("spread"))
    places = materialize(keyed.groupBy("key").agg(F.max("first").alias("first"), F.max("spread").alias("spread")))
    shape = materialize(keyed.select("repo_id", "key").join(places, "key").groupBy("repo_id").agg(F.max(F.col("first") + F.col("spread")).alias("parts")))

    def placed(df: DataFrame, end: str) -> DataFrame:
        """df with the part of an end; a cell that is more than a part is spread over several."""
        at = _few(places.select(*(F.col(c).alias(f"{end}_{c}") for c in places.columns)), many)
        part = F.col(f"{end}_first") + F.when(F.col(f"{end}_spread") > 1, F.pmod(F.xxhash64(F.lit(1), f"{end}_id"), f"{end}_spread")).otherwise(0).cast("int")
        return df.withColumn(f"{end}_key", key(cell(end))).join(at, f"{end}_key").withColumn(f"{end}_part", part)

    often = max(1, int(count * HOT_SHARE), size // 4)
    heavy = cells.filter(F.col("out") > often).select("repo_id", F.col("cell").alias("src_cell"))
    hot = None
    if not heavy.isEmpty():
        frequent = links.withColumn("src_cell", cell("src")).join(F.broadcast(heavy), ["repo_id", "src_cell"], "left_semi").groupBy("repo_id", "src_id").agg(F.count("*").alias("n"))
        frequent = materialize(frequent.filter(F.col("n") > often).select(F.col("repo_id").alias("hot_repo"), F.col("src_id").alias("hot_id")))
        same = (F.col("repo_id") == F.col("hot_repo")) & F.col("src_id").eqNullSafe(F.col("hot_id"))
        if not frequent.isEmpty():
            degrees = links.join(F.broadcast(frequent), same).distinct().groupBy("repo_id", "src_id").agg(F.count("*").alias("degree"))
            number = F.row_number().over(Window.partitionBy("repo_id").orderBy("src_part", "src_id")) - 1
            hot = materialize(placed(degrees, "src").select("repo_id", F.col("src_part").alias("part"), "src_id", "degree", number.alias("hot")))
    dealt = placed(placed(links, "src"), "dst")
    if hot is None:
        dealt = dealt.select("repo_id", F.col("src_part").alias("part"), "src_id", "dst_id", "dst_part")
    else:
        numbers = hot.select(F.col("repo_id").alias("hot_repo"), F.col("src_id").alias("hot_id"), "hot")
        dealt = dealt.join(F.broadcast(numbers), same, "left").select("repo_id", F.when(F.col("hot").isNull(), F.col("src_part")).otherwise(F.col("dst_part")).alias("part"), "src_id", "dst_id", "dst_part", "hot")
    task = F.pmod(F.pmod(F.xxhash64("repo_id"), F.lit(tasks)) + F.col("part"), F.lit(tasks)).cast("int")
    # Written before it is dealt on, so that a part and what it sends are of one attempt of a task.
    with _batches_by_rows(links.sparkSession):
        held = materialize(dealt.repartitionById(tasks, task).mapInArrow(_dealt, _DEALT.format(kind)))
    rows = held if hot is None else held.unionByName(hot.groupBy(*PART).applyInArrow(_hot_nodes, _DEALT.format(kind)))
    parts = materialize_by(rows.groupBy(*PART).applyInArrow(_numbered, _PART.format(kind)), *PART, rows=about)
    for table in [held, cells, places] + ([] if hot is None else [hot]):
        discard(table)
    return parts, shape


def pagerank(
    edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float | None = 1e-6, local_links: int = LOCAL_LINKS, rows: int | None = None, near: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(repo_id, node_id, rank) of all nodes on edges (repo_id, src_id, dst_id); parallel edges count once.

    The mass of a repository's nodes without outgoing edges is spread evenly over it. A repository is
    done when its ranks move by less than its nodes times tolerance in sum; with tolerance None all
    stop after max_iterations. Up to local_links links are ranked by one task, which holds so many; the
    ranks are the same.

    Beyond, nodes are dealt by cells to parts of about as many links each, and links to the part of their
    source, once; there they are two arrays, sorted by target. In a round each part sends every part of its
    repository the sums of shares by target there, in an order that both know, so links, ids and
    numbers of nodes stay where they are. Links of the few sources with most of them lie with their
    targets, which get the source's share instead.
    rows: about how many edges there are at most, if they are cheap to derive three times; they are written first if it isn't known.
    near: a number of an id (of any type) that nodes have in common which tend to link to the same ones; parts hold
    neighbouring numbers, so they send fewer sums. The ranks don't depend on it.
    """
    links = scoped(edges).select("repo_id", "src_id", "dst_id")
    links, kind = links if rows else materialize(links), links.schema["src_id"].dataType.simpleString()
    about = rows or links.count()
    if about and about <= local_links:

        def run(parts):
            whole = [p for p in parts if len(p)]
            if whole:
                yield _ranks(pd.concat(whole), damping, max_iterations, tolerance)

        texts = links.select("repo_id", *(F.col(c).cast("string") for c in ("src_id", "dst_id")))
        ranks = materialize(distinct_by(texts, about, "repo_id", "src_id", "dst_id").coalesce(1).mapInPandas(run, "repo_id string, node_id string, rank double"))
        return ranks if kind == "string" else ranks.withColumn("node_id", F.col("node_id").try_cast(kind))
    parts, shape = _parts(links, about, near)
    if parts is None:
        return links.select("repo_id", F.col("src_id").alias("node_id"), F.lit(0.0).alias("rank"))
    if not rows:
        discard(links)
    sizes = parts.groupBy("repo_id").agg(F.sum("nodes").alias("n")).join(shape, "repo_id")
    ranks = materialize(parts.select(*PART).join(sizes, "repo_id").select(*PART, "parts", "n", F.lit(None).cast("binary").alias("rank"), F.lit(float("inf")).alias("moved"), F.lit(False).alias("done")))
    for _ in range(max_iterations):
        mine = parts.join(ranks.hint("shuffle_hash"), PART)
        messages = mine.select(*PART, "parts", "nodes", "degree", "sent", "starts", "cuts", "hot", "n", "rank", "moved").mapInArrow(_sent, _MESSAGE)
        own = mine.select(*PART, "parts", "nodes", "got", "hot_sent", "hot_got", "n", "rank")
        watch = Observation()
        fresh = own.groupBy(*PART).cogroup(messages.groupBy(*PART)).applyInArrow(_received(damping, tolerance), _RANKS).observe(watch, F.count(F.when(~F.col("done"), 1)).alias("open"))
        before, ranks = ranks, materialize(fresh)
        discard(before)
        if not watch.get["open"]:  # nothing has moved
            break
    named = materialize(parts.select(*PART, "ids").join(ranks.select(*PART, "n", "rank").hint("shuffle_hash"), PART).mapInArrow(_named, f"repo_id string, node_id {kind}, rank double"))
    for table in (parts, ranks, shape):
        discard(table)
    return named


def ranked_links(edges: DataFrame) -> DataFrame:
    """The links that ranks follow: calls and imports."""
    return scoped(edges).filter(F.col("edge_type").isin("CALLS", "IMPORTS")).select("repo_id", "src_id", "dst_id").distinct()


def same_links(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of edges have the same ranked links, by their number and two checksums."""
    sums = lambda e: ranked_links(e).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("repo_id", "src_id", "dst_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "dst_id", "src_id", "repo_id")).alias("y"))
    x, y = sums(a).unionByName(sums(b)).collect()
    return x == y


def with_ranks(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """nodes with ranks (repo_id, node_id, rank) as centrality, and importance: centrality raised by change frequency."""
    joined = scoped(nodes).join(scoped(ranks).select(*ID, F.col("rank").alias("fresh")), ID, "left")
    centrality = F.coalesce("fresh", F.lit(0.0))  # a node off the links has none, whatever it had before
    return joined.withColumns({
        "centrality_score": centrality, "importance_score": centrality * (1 + F.coalesce("change_frequency", F.lit(0.0))),
    }).drop("fresh")


def with_importance(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """nodes with centrality (rank over calls and imports) and importance."""
    return with_ranks(nodes, pagerank(ranked_links(edges), **options))

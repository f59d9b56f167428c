"""Graph traversal by joins: reach, neighbourhood, shortest paths, and target resolution.

Traversals keep a frontier and what has been seen, so a node is expanded once whatever the number of
walks to it. All starts of a batch are traversed together, keyed by seed. A node is named by its
repository and id: repositories that share a store, and even paths, don't meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import counts_by, materialize, materialize_by

MAX_DEPTH, MAX_PATH = 10, 20
#: Rows of a frontier that is sent to wherever the steps are, some 100 bytes each; a larger one goes to its nodes' buckets.
FEW_ROWS = 100_000
#: A node is a hub if it has more than this share of the steps; fewer than one over it can be.
HUB_SHARE = 0.001
#: What names a node.
ID = ["repo_id", "node_id"]


def scoped(df: DataFrame) -> DataFrame:
    """df with repo_id filled in: empty where a row, or the whole table, has none."""
    return df.withColumn("repo_id", F.coalesce("repo_id", F.lit("")) if "repo_id" in df.columns else F.lit(""))


def checked_depth(depth, low: int = 1, high: int = MAX_DEPTH) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int):
        raise TypeError(f"depth must be an integer, not {type(depth).__name__}")
    if not low <= depth <= high:
        raise ValueError(f"depth must be between {low} and {high}, not {depth}")
    return depth


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(repo_id, at, to): one step against the edges ('in'), along them ('out'), or either way ('both')."""
    along = scoped(edges).select("repo_id", F.col("src_id").alias("at"), F.col("dst_id").alias("to"))
    against = along.select("repo_id", F.col("to").alias("at"), F.col("at").alias("to"))
    return {"out": along, "in": against, "both": along.unionByName(against)}[direction].filter("at <> to")


class Adjacency:
    """The steps of a graph, written once, from which a traversal goes on level by level without shuffling them.

    A small frontier is broadcast and meets the steps where they lie. For a larger one the steps are dealt
    into buckets by node, the first time that there is one; then the frontier alone is shuffled. Hubs, of
    which there are few, stay out of the buckets, since one would fill one: theirs are met by broadcast.
    written: whether edges are a written table, whose rows then serve as steps without being written again.
    """

    def __init__(self, edges: DataFrame, direction: str, few: int = FEW_ROWS, *, written: bool = False):
        self.steps, self.few = steps(edges, direction) if written else materialize(steps(edges, direction)), few
        self._dealt: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def _buckets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hubs, their steps, the others' steps in buckets)."""
        if self._dealt is None:
            rows = self.steps.count()
            often = max(1, int(rows * HUB_SHARE))
            hubs = materialize(counts_by(self.steps, rows, "repo_id", "at").filter(F.col("n") > often).select("repo_id", "at"))
            sent = F.broadcast(hubs)  # fewer than 1 / HUB_SHARE rows
            self._dealt = hubs, self.steps.join(sent, ["repo_id", "at"], "left_semi"), materialize_by(self.steps.join(sent, ["repo_id", "at"], "left_anti"), "repo_id", "at", rows=rows)
        return self._dealt

    def met(self, frontier: DataFrame, rows: int) -> DataFrame:
        """(repo_id, seed, at, node_id), repeats included: the steps from a written frontier (repo_id, seed, node_id) of so many rows."""
        at = frontier.select("repo_id", "seed", F.col("node_id").alias("at"))
        if rows <= self.few:
            met = self.steps.join(F.broadcast(at), ["repo_id", "at"])
        else:
            hubs, hot, rest = self._buckets()
            of_hubs = at.join(F.broadcast(hubs), ["repo_id", "at"], "left_semi")
            # A hub's seeds may be many: its steps and seeds meet in a join that can be split.
            met = rest.join(at.join(F.broadcast(hubs), ["repo_id", "at"], "left_anti"), ["repo_id", "at"]).unionByName(hot.join(of_hubs, ["repo_id", "at"]))
        return met.select("repo_id", "seed", "at", F.col("to").alias("node_id"))

    def ahead(self, frontier: DataFrame, rows: int) -> DataFrame:
        """(repo_id, seed, node_id), distinct: where steps from a written frontier (repo_id, seed, node_id) of so many rows lead."""
        return self.met(frontier, rows).select("repo_id", "seed", "node_id").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "in", edge_types=None, written: bool = False) -> DataFrame:
    """(repo_id, seed, node_id, distance) of all nodes within depth steps of starts (repo_id, seed, node_id), these included at 0."""
    if edge_types is not None:
        edges = edges.filter(F.col("edge_type").isin(*edge_types))
    near = Adjacency(edges, direction, written=written)
    levels = [materialize(scoped(starts).select("repo_id", "seed", "node_id").distinct().withColumn("distance", F.lit(0)))]
    rows = levels[0].count()
    for d in range(1, depth + 1):
        # A step in any direction leads back by one level at most; one along directed edges, anywhere.
        seen = reduce(DataFrame.unionByName, levels[-2:] if direction == "both" else levels)
        found = near.ahead(levels[-1], rows).join(seen, ["repo_id", "seed", "node_id"], "left_anti")
        levels.append(materialize(found.withColumn("distance", F.lit(d))))
        rows = levels[-1].count()
        if not rows:
            break
    return reduce(DataFrame.unionByName, levels)


def resolve(nodes: DataFrame, target: str, repo_id: str | None = None) -> str | None:
    """The id of the node that a name stands for."""
    found = resolve_scoped(nodes, target, repo_id)
    return found and found[1]


def resolve_scoped(nodes: DataFrame, target: str, repo_id: str | None = None) -> tuple[str, str] | None:
    """(repo_id, node_id) of the node that a name stands for: its id, fqn or name exactly, else a part of fqn or name; most important first."""
    if not target:
        return None
    nodes = scoped(nodes)
    if repo_id:
        nodes = nodes.filter(F.col("repo_id") == repo_id)
    t = F.lit(target)
    exact = F.when(F.col("fqn") == t, 0).when(F.col("node_id") == t, 1).when(F.col("name") == t, 2).otherwise(3)
    row = (
        nodes.filter(F.contains("fqn", t) | F.contains("name", t) | (F.col("node_id") == t))
        .select(*ID, exact.alias("rank"), "importance_score")
        .orderBy("rank", F.desc("importance_score"), "node_id", "repo_id").limit(1).collect()
    )
    return (row[0].repo_id, row[0].node_id) if row else None


def best_first(nodes: DataFrame, limit: int | None) -> DataFrame:
    last = ["repo_id"] if "repo_id" in nodes.columns else []
    ordered = nodes.orderBy(F.desc("importance_score"), "node_id", *last)
    return ordered if limit is None else ordered.limit(limit)


def _around(nodes: DataFrame, edges: DataFrame, start: tuple[str, str] | None, depth: int, limit: int | None, direction: str, edge_types) -> DataFrame:
    if start is None:
        return nodes.limit(0).withColumn("distance", F.lit(0))
    starts = nodes.sparkSession.createDataFrame([(*start, start[1])], "repo_id string, seed string, node_id string")
    found = reach(edges, starts, depth, direction, edge_types).filter("distance > 0").select(*ID, "distance")
    return best_first(scoped(nodes).join(found, ID), limit)


def dependents(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 3, limit: int | None = 20, repo_id: str | None = None, edge_types=None) -> DataFrame:
    """Nodes that reach the target in at most depth steps, with their distance."""
    checked_depth(depth)
    return _around(nodes, edges, resolve_scoped(nodes, target, repo_id), depth, limit, "in", edge_types)


def neighbourhood(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2, limit: int | None = 20, repo_id: str | None = None) -> DataFrame:
    checked_depth(depth)
    return _around(nodes, edges, resolve_scoped(nodes, target, repo_id), depth, limit, "both", None)


def _met(near: Adjacency, repo_id: str, src: str, dst: str, max_depth: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame] | None:
    """(steps from src by level, steps from dst by level, nodes where they meet): both ends are searched, the one with the smaller frontier first.

    Steps (repo_id, seed, at, node_id) are written as they are met. All steps are scanned once a level, and
    once for a level of either end while both frontiers are small.
    """
    row = near.steps.sparkSession.range(1, numPartitions=1)
    levels = {end: [materialize(row.select(F.lit(repo_id).alias("repo_id"), F.lit(end).alias("seed"), F.lit(end).alias("node_id")))] for end in (src, dst)}
    rows, hops, known = {src: 1, dst: 1}, {src: [], dst: []}, {}
    for left in range(max_depth, 0, -1):
        end, other = (src, dst) if src in known or not known and rows[src] <= rows[dst] else (dst, src)
        if not known:
            asked = [end, other] if left > 1 and rows[end] + rows[other] <= near.few else [end]
            frontier = reduce(DataFrame.unionByName, [levels[e][-1] for e in asked])
            # A step leads back by one level at most.
            seen = reduce(DataFrame.unionByName, [level for e in asked for level in levels[e][-2:]])
            met = materialize(near.met(frontier, sum(rows[e] for e in asked)).join(seen, ["repo_id", "seed", "node_id"], "left_anti"))
            known |= {e: met.filter(F.col("seed") == e) for e in asked}
        hops[end].append(known.pop(end))
        levels[end].append(materialize(hops[end][-1].select("repo_id", "seed", "node_id").distinct()))
        rows[end] = levels[end][-1].count()
        # Levels met no earlier, so they can only meet at the last ones.
        both = levels[end][-1].select(*ID).join(levels[other][-1].select(*ID), ID, "left_semi")
        if not both.isEmpty():
            return hops[src], hops[dst], both
        if not rows[end]:
            return None
    return None


def shortest_paths(edges: DataFrame, src: str, dst: str, max_depth: int = 6, limit: int = 3, repo_id: str = "", written: bool = False) -> DataFrame:
    """(path, hops): the first shortest undirected paths by their ids within a repository, at most limit.

    Searches from both ends meet halfway, so neither fans out over the whole distance. Steps on shortest
    paths are, among those that the searches have written, the ones behind the meeting points. Paths grow
    along them from src; of each length the limit smallest are kept, which hold the prefixes of the limit
    smallest whole paths. Edges may be repeated.
    """
    checked_depth(max_depth, 1, MAX_PATH)
    paths = edges.sparkSession.range(1, numPartitions=1).select(F.array(F.lit(src)).alias("path"))
    if src == dst:
        return paths.withColumn("hops", F.lit(0))
    near = Adjacency(scoped(edges).filter(F.col("repo_id") == repo_id), "both", written=written)
    found = _met(near, repo_id, src, dst, max_depth)
    if found is None:
        return paths.limit(0).withColumn("hops", F.lit(0))
    ahead, behind, on_path = found
    forth = []
    for hops in reversed(ahead):
        forth.append(materialize(hops.join(on_path.select(*ID), ID, "left_semi").select("repo_id", "at", F.col("node_id").alias("to")).distinct()))
        on_path = forth[-1].select("repo_id", F.col("at").alias("node_id")).distinct()
    # Every step of the search from dst leads to it, if taken backwards.
    back = [hops.select("repo_id", F.col("node_id").alias("at"), F.col("at").alias("to")) for hops in reversed(behind)]
    for hops in [*reversed(forth), *back]:
        ends = F.broadcast(paths.withColumn("at", F.element_at("path", -1)))  # limit rows at most
        paths = materialize(hops.join(ends, "at").select(F.concat("path", F.array("to")).alias("path")).distinct().orderBy("path").limit(limit))
    return paths.withColumn("hops", F.lit(len(ahead) + len(behind)))

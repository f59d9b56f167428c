"""FIND, named lookups and counts over the node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NODE_KEYWORDS
from ..tables import distinct_by
from .traverse import ID, best_first, scoped

DEFAULT_LIMIT = 20


def condition(field: str, op: str, value: str) -> Column | None:
    """One WHERE condition; None for a field that isn't known. Only name tells '=' from the other operators."""
    if field == "tag":
        return F.array_contains("tags", value)
    if field == "name":
        return F.col("name") == value if op == "=" else F.contains("name", F.lit(value))
    if field in ("file", "fqn"):
        return F.contains({"file": "file_path", "fqn": "fqn"}[field], F.lit(value))
    if field == "language":
        return F.col("language") == value
    return None


def find(nodes: DataFrame, node_type: str | None = None, filters=(), limit: int | None = None, repo_id: str | None = None, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Nodes of a type (a keyword; an unknown one means any) that meet all filters (field, op, value), most important first."""
    wanted = NODE_KEYWORDS.get((node_type or "").lower())
    tests = [F.col("node_type") == wanted] if wanted else []
    tests += [F.col("repo_id") == repo_id] if repo_id else []
    tests += [c for f in filters if (c := condition(*f)) is not None]
    return best_first(nodes.filter(reduce(Column.__and__, tests)) if tests else nodes, limit or default_limit)


def needle(filters) -> str | None:
    """The longest text that the name or fqn of a node must hold to meet all filters."""
    return max((value for field, _, value in filters if field in ("name", "fqn")), key=len, default=None)


def by_name(nodes: DataFrame, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return best_first(nodes.filter((F.col("name") == text) | F.contains("fqn", F.lit(text))), limit)


def linked(nodes: DataFrame, edges: DataFrame, ids: DataFrame, edge_type: str, against: bool, rows: int | None = None) -> DataFrame:
    """(anchor, columns of nodes): nodes one edge away from ids (repo_id, node_id); against: at its source. An anchor isn't its own neighbour.

    Anchors filter the edges first, so that only theirs are made distinct. rows: about how many edges of
    the type there are at most, if that is known; as many tasks as these ask for then drop the repeats.
    """
    near, far = ("dst_id", "src_id") if against else ("src_id", "dst_id")
    of_type = scoped(edges).filter((F.col("edge_type") == edge_type) & (F.col("src_id") != F.col("dst_id")))
    anchors = scoped(ids).select("repo_id", F.col("node_id").alias("anchor"))
    hops = of_type.select("repo_id", F.col(near).alias("anchor"), F.col(far).alias("node_id")).join(anchors, ["repo_id", "anchor"], "left_semi")
    hops = hops.distinct() if rows is None else distinct_by(hops, rows, "repo_id", "anchor", "node_id")
    return hops.join(scoped(nodes), ID)


def callers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    return linked(nodes, edges, ids, "CALLS", True, rows)


def callees(nodes: DataFrame, edges: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    return linked(nodes, edges, ids, "CALLS", False, rows)


def importers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    return linked(nodes, edges, ids, "IMPORTS", True, rows)


def tests_of(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    return linked(nodes, edges, ids, "TESTED_BY", False)


def counts(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg(F.count("*").alias("n"))


def by_id(nodes: DataFrame, node_id: str, repo_id: str | None = None) -> DataFrame:
    """The node of that id, in each repository that has one unless one is named."""
    found = nodes.filter(F.col("node_id") == node_id)
    return found.filter(F.col("repo_id") == repo_id) if repo_id else found


def of_type(nodes: DataFrame, node_type: str, limit: int | None = None) -> DataFrame:
    return best_first(nodes.filter(F.col("node_type") == node_type), limit)


def files(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") == "File").orderBy("file_path")


def most_important(nodes: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return best_first(nodes, limit)


def exported(edges: DataFrame, edge_type: str) -> DataFrame:
    """(src_id, dst_id) of all edges of a type, e.g. for a graph library."""
    return edges.filter(F.col("edge_type") == edge_type).select("src_id", "dst_id")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes in ids (repo_id, node_id), and the edges between them."""
    wanted = scoped(ids).select(*ID)
    inner = scoped(edges)
    for end in ("src_id", "dst_id"):
        inner = inner.join(wanted.withColumnRenamed("node_id", end), ["repo_id", end], "left_semi")
    return scoped(nodes).join(wanted, ID, "left_semi"), inner

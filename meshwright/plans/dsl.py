"""The query language: text to a small syntax tree, and the tree to a DataFrame.

    FIND [type] [WHERE field op value [AND ...]] [LIMIT n] | DEPENDENTS sym
    IMPACT sym [DEPTH n] | PATH FROM sym TO sym
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import find as find_
from ..operators.traverse import ID, dependents, resolve_scoped, scoped, shortest_paths
from ..schema import NODE_KEYWORDS

#: Quoted strings, words, numbers, and any other sign by itself.
_TOKEN = re.compile(r"\"[^\"]*\"|'[^']*'|[^\W\d]\w*|\d+|\S", re.ASCII)
PATH_DEPTH, REACH_DEPTH = 6, 3


@dataclass
class Find:
    node_type: str | None = None
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Reach:
    target: str
    depth: int = REACH_DEPTH


@dataclass
class Path:
    src: str
    dst: str


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _plain(token: str) -> str:
    return token.strip("\"'")


def parse(text: str) -> Find | Reach | Path | None:
    """None for an empty text or an unknown keyword. Words that fit nowhere are skipped; a bad number raises ValueError."""
    first, *rest = tokens(text.strip()) or [""]
    match first.upper():
        case "FIND":
            return _parse_find(rest)
        case "DEPENDENTS":
            return Reach(_plain(rest[0]) if rest else "")
        case "IMPACT":
            deep = len(rest) > 2 and rest[1].upper() == "DEPTH"
            return Reach(_plain(rest[0]) if rest else "", int(rest[2]) if deep else REACH_DEPTH)
        case "PATH":
            ends = {a.upper(): _plain(b) for a, b in zip(rest, rest[1:]) if a.upper() in ("FROM", "TO")}
            return Path(ends.get("FROM", ""), ends.get("TO", ""))
    return None


def _parse_find(words: list[str]) -> Find:
    query = Find()
    if words and (words[0] == "*" or words[0].lower() in NODE_KEYWORDS):
        query.node_type = words.pop(0)
    while words:
        word = words.pop(0).upper()
        if word == "LIMIT" and words:
            query.limit = int(words.pop(0))
        elif word in ("WHERE", "AND") and len(words) >= 3:
            name, op, value = words[:3]
            del words[:3]
            query.filters.append((name.lower(), op, _plain(value)))
    return query


def execute(query: str | Find | Reach | Path | None, nodes: DataFrame, edges: DataFrame, repo_id: str | None = None, default_limit: int = find_.DEFAULT_LIMIT, path_depth: int = PATH_DEPTH) -> DataFrame:
    """The nodes that a query finds, with input_rank (their order); for PATH also path_no and step."""
    tree = parse(query) if isinstance(query, str) else query
    if isinstance(tree, Find):
        return _numbered(find_.find(nodes, tree.node_type, tree.filters, tree.limit, repo_id, default_limit))
    if isinstance(tree, Reach):
        return _numbered(dependents(nodes, edges, tree.target, tree.depth, default_limit, repo_id))
    if isinstance(tree, Path):
        return path_nodes(nodes, edges, tree.src, tree.dst, path_depth, repo_id)
    return _numbered(nodes.limit(0))


def path_nodes(nodes: DataFrame, edges: DataFrame, src: str, dst: str, max_depth: int = PATH_DEPTH, repo_id: str | None = None) -> DataFrame:
    """The nodes of the first shortest paths; the other end is looked for in the repository of the first."""
    a = resolve_scoped(nodes, src, repo_id)
    b = a and resolve_scoped(nodes, dst, repo_id or a[0])
    if a is None or b is None or a == b:
        return _numbered(nodes.limit(0)).withColumns({"path_no": F.lit(0), "step": F.lit(0)})
    repo = a[0]
    paths = [r.path for r in shortest_paths(edges, a[1], b[1], max_depth, repo_id=repo).orderBy("path").collect()]
    rows = [(repo, p, i, node) for p, path in enumerate(paths) for i, node in enumerate(path)]
    listed = nodes.sparkSession.createDataFrame(rows, "repo_id string, path_no int, step int, node_id string")
    return listed.join(scoped(nodes), ID).withColumn("input_rank", F.col("path_no") * 100 + F.col("step")).orderBy("input_rank")


def _numbered(found: DataFrame) -> DataFrame:
    """Results are at most a page of rows, so a global row number is cheap."""
    from pyspark.sql import Window as W

    return found.withColumn("input_rank", F.row_number().over(W.orderBy(F.desc("importance_score"), "node_id")))

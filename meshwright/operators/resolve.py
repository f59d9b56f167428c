"""Edge resolution: from parsed, unresolved edges to links between nodes, by equality joins.

Order of preference for an edge's target text: a node id; an fqn; for imports a file path; otherwise a
name that only one node has, at reduced confidence. Where several nodes share an fqn or a path the last
one counts; of nodes with one id, and edges with one id, the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import edge_id, module_path
from ..schema import ALLOWED_PAIRS

IMPORT_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", "/__init__.py", "/index.ts", "/index.js")
NAME_CONFIDENCE = 0.7


def first_of(df: DataFrame, key: list[str], *order) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    return first_of(nodes, ["repo_id", "node_id"], "file_ord", "node_ord")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return first_of(edges, ["repo_id", "edge_id"], "file_path", "edge_ord")


def definitions(nodes: DataFrame) -> DataFrame:
    """KEYS rows of the texts by which nodes can be meant: a node's id, fqn and name, and the path of a file."""
    role = lambda name, key: F.struct(F.lit(name).alias("role"), key.alias("key"))
    path = F.when(F.col("node_type").isin("File", "ConfigFile"), F.col("file_path"))
    roles = F.array(role("id", F.col("node_id")), role("fqn", F.col("fqn")), role("name", F.col("name")), role("path", path))
    each = nodes.withColumn("_r", F.explode(roles)).filter(F.coalesce("_r.key", F.lit("")) != "")
    return each.select("repo_id", "_r.key", "_r.role", "file_path", "node_id", "node_type", "file_ord", F.col("node_ord").cast("int").alias("node_ord"))


def references(raw: DataFrame) -> DataFrame:
    """KEYS rows of the texts that edges refer to, once for each file: target texts, and paths without suffix that imports name."""
    named = raw.select("repo_id", "file_path", F.explode(F.array(
        F.struct(F.lit("ref").alias("role"), F.col("dst_ref").alias("key")), F.struct(F.lit("base").alias("role"), import_base(raw).alias("key")))).alias("r"))
    none = F.lit(None).cast("string")
    return named.select("repo_id", "r.key", "r.role", "file_path", none.alias("node_id"), none.alias("node_type"), none.alias("file_ord"), F.lit(None).cast("int").alias("node_ord")).filter("key <> ''").distinct()


def relative_path(file_path, ref):
    """A reference that begins with a dot, resolved against its file: './a', '../a' and, in Python, '.a', '..b.c'.

    Returned without a suffix.
    """
    folder = F.regexp_replace(file_path, "[^/]+$", "")
    slashes = ref.contains("/")
    dots = F.length(F.regexp_extract(ref, r"^(\.+)", 1))
    ups = F.when(slashes, F.size(F.regexp_extract_all(ref, F.lit(r"\.\./"), F.lit(0)))).otherwise(dots - 1)
    rest = F.when(slashes, F.regexp_replace(ref, r"^(\.{1,2}/)+", "")).otherwise(F.replace(F.regexp_replace(ref, r"^\.+", ""), F.lit("."), F.lit("/")))
    # One fold over as many levels as there are parents to take off.
    levels = F.slice(F.array_repeat(F.lit(0), 64), 1, F.greatest(F.lit(0), F.least(ups, F.lit(64))))
    up = F.aggregate(levels, folder, lambda at, _: F.regexp_replace(at, "[^/]+/$", ""))
    return F.concat(up, rest)


def import_base(edges: DataFrame) -> F.Column:
    """For an import the path, without a suffix, that its target names; empty for other edges."""
    ref = F.col("dst_ref")
    path = F.when(ref.startswith("."), relative_path(F.col("file_path"), ref)).otherwise(module_path(ref, ""))
    return F.when(F.col("edge_type") == "IMPORTS", path).otherwise("")


#: Order of preference of what a text may be; imports' suffixes stand between.
_ID, _FQN, _PATH, _NAME = 0, 1, 2, 100


def tries(refs: DataFrame) -> DataFrame:
    """(repo_id, dst_ref, base, rank, role, key): the definitions that a text and base could mean, the smallest rank first."""
    one = lambda rank, role, key: F.struct(F.lit(rank).alias("rank"), F.lit(role).alias("role"), key.alias("key"))
    paths = [one(_PATH + i, "path", F.when(F.col("base") != "", F.concat("base", F.lit(s)))) for i, s in enumerate(IMPORT_SUFFIXES)]
    name = one(_NAME, "name", F.when(F.col("base") == "", F.col("dst_ref")))  # imports don't fall back to names
    tried = F.array(one(_ID, "id", F.col("dst_ref")), one(_FQN, "fqn", F.col("dst_ref")), *paths, name)
    return refs.withColumn("t", F.explode(tried)).select("repo_id", "dst_ref", "base", "t.rank", "t.role", "t.key").filter("key is not null")


def resolve_targets(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """(repo_id, dst_ref, base, dst_id, dst_type, by_name) of each distinct target text that can be resolved.

    defined: all definitions (KEYS rows) of the texts that tries() lists. Each text's definitions are one
    row: the last in file and node order, and for a name how many nodes have it.
    """
    found = tries(refs)
    last = F.max_by(F.struct("node_id", "node_type"), F.struct("file_ord", "node_ord", "node_id"))
    meant = defined.groupBy("repo_id", "role", "key").agg(last.alias("d"), F.count("*").alias("n")).filter("role <> 'name' or n = 1")
    first = found.join(meant, ["repo_id", "role", "key"]).groupBy("repo_id", "dst_ref", "base").agg(F.min(F.struct("rank", "d")).alias("m"))
    return first.select("repo_id", "dst_ref", "base", F.col("m.d.node_id").alias("dst_id"), F.col("m.d.node_type").alias("dst_type"), (F.col("m.rank") == _NAME).alias("by_name"))


def resolve_with(raw: DataFrame, sources: DataFrame, defined: DataFrame) -> DataFrame:
    """raw edges whose source is in sources (repo_id, src_id) with dst_id and dst_type, resolved among definitions and deduplicated.

    Texts are resolved, not edges: a text that a third of all calls share (a built-in's name) is looked
    up once, and edges meet the texts that were resolved in one inner join.
    """
    edges = raw.withColumn("base", import_base(raw)).join(sources.select("repo_id", "src_id"), ["repo_id", "src_id"], "left_semi")
    targets = resolve_targets(edges.select("repo_id", "dst_ref", "base").distinct(), defined)
    done = edges.join(targets, ["repo_id", "dst_ref", "base"])
    sure = F.when(F.col("by_name"), F.least("confidence", F.lit(NAME_CONFIDENCE))).otherwise(F.col("confidence"))
    return dedupe_edges(done.withColumn("confidence", sure).drop("base", "by_name"))


def resolve_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """raw edges (repo_id, src_id, dst_ref, ..) with dst_id, resolved among all nodes; what can't be resolved is dropped."""
    return resolve_with(raw, nodes.select("repo_id", F.col("node_id").alias("src_id")), definitions(nodes)).drop("dst_type")


def valid_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist and whose types' pair the schema admits."""
    types = nodes.select("repo_id", "node_id", "node_type")
    pairs = edges.sparkSession.createDataFrame(ALLOWED_PAIRS, "edge_type string, src_type string, dst_type string")
    typed = edges.join(types.select("repo_id", F.col("node_id").alias("src_id"), F.col("node_type").alias("src_type")), ["repo_id", "src_id"])
    typed = typed.join(types.select("repo_id", F.col("node_id").alias("dst_id"), F.col("node_type").alias("dst_type")), ["repo_id", "dst_id"])
    return typed.join(F.broadcast(pairs), ["edge_type", "src_type", "dst_type"], "left_semi").drop("src_type", "dst_type")  # a fixed table


def tested_by(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """TESTED_BY edges (symbol to test) from the calls that tests make."""
    tests = nodes.filter(F.col("node_type") == "Test").select("repo_id", F.col("node_id").alias("src_id"))
    calls = resolved.filter(F.col("edge_type") == "CALLS").join(tests, ["repo_id", "src_id"], "left_semi")
    turned = calls.select(*(F.col(c) for c in calls.columns if c not in ("src_id", "dst_id", "edge_type", "edge_id")), F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit("TESTED_BY").alias("edge_type"))
    return dedupe_edges(turned.withColumn("edge_id", edge_id(F.col("src_id"), F.lit("TESTED_BY"), F.col("dst_id"))))

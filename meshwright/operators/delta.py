"""What a change to some files asks for: which edges have to be resolved again, and among which nodes.

A node can be meant by its id, fqn, name or path. If none of these came, went or changed hands, no edge
of another file can have a new target. The table of keys tells, by the text, who defines one and which
files refer to it; so what is read grows with the texts that changed and those that changed edges name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, RAW_EDGES
from .resolve import IMPORT_SUFFIXES, definitions, import_base, references

#: What makes a node the same target as before.
IDENTITY = ["repo_id", "node_id", "node_type", "name", "fqn", "file_path"]
REFERS, DEFINES = ("ref", "base"), ("id", "fqn", "name", "path")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks."""
    return a.subtract(b).unionByName(b.subtract(a))


def affected_references(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, role, key): references that may have another target, between the old and new nodes of changed files."""
    moved = differing(old.select(*IDENTITY), new.select(*IDENTITY))
    defined = definitions(moved.withColumns({"file_ord": F.lit(None).cast("string"), "node_ord": F.lit(None).cast("int")}))
    stems = F.array_compact(F.array(*(F.when(F.endswith("key", F.lit(s)), F.expr(f"left(key, length(key) - {len(s)})")) for s in IMPORT_SUFFIXES)))
    refers = F.when(F.col("role") == "path", F.transform(stems, lambda k: F.struct(F.lit("base").alias("role"), k.alias("key")))).otherwise(F.array(F.struct(F.lit("ref").alias("role"), F.col("key").alias("key"))))
    return defined.select("repo_id", F.explode(refers).alias("r")).select("repo_id", "r.role", "r.key").distinct()


def sources_naming(raw: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, src_id): sources of raw edges that have a reference in keys (repo_id, role, key)."""
    named = raw.select("repo_id", "src_id", F.explode(F.array(
        F.struct(F.lit("ref").alias("role"), F.col("dst_ref").alias("key")), F.struct(F.lit("base").alias("role"), import_base(raw).alias("key")))).alias("r"))
    return named.select("repo_id", "src_id", "r.role", "r.key").join(keys, ["repo_id", "role", "key"], "left_semi").select("repo_id", "src_id").distinct()


def sources_rewritten(old_raw: DataFrame, raw: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, src_id): sources whose edges differ, in content or order, or whose node does. A source's edges are those of one node of one file."""
    def listed(edges: DataFrame) -> DataFrame:
        row = F.xxhash64(*(c for c in RAW_EDGES.names if c != "edge_ord"))
        return edges.groupBy("repo_id", "src_id").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", row.alias("h")))), lambda e: e.h)).alias("edges"))

    edges = differing(listed(old_raw), listed(raw)).select("repo_id", "src_id")
    nodes = differing(old.select(*IDENTITY), new.select(*IDENTITY)).select("repo_id", F.col("node_id").alias("src_id"))
    return edges.unionByName(nodes).distinct()


def owner() -> F.Column:
    """The node whose raw edges an edge comes from: its source, or for TESTED_BY the test."""
    return F.when(F.col("edge_type") == "TESTED_BY", F.col("dst_id")).otherwise(F.col("src_id"))


def without_owners(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges but those that come from the raw edges of sources (repo_id, src_id)."""
    gone = sources.select("repo_id", F.col("src_id").alias("_owner"))
    return edges.withColumn("_owner", owner()).join(gone, ["repo_id", "_owner"], "left_anti").drop("_owner")


def defined(nodes: DataFrame) -> DataFrame:
    """definitions() as they are stored: with a place in the file only where two nodes of a file share a text, which is its path."""
    return definitions(nodes).withColumn("node_ord", F.when(F.col("role") == "path", F.col("node_ord"))).select(*KEYS.names)


def keys_of(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    return defined(nodes).unionByName(references(raw).select(*KEYS.names))

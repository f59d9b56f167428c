"""The stored graph: Parquet tables in parts, of which a write makes only those anew that it touches.

A table's rows are dealt by repository and by a hash of their file (or key) into parts. A write puts
the parts that it has made into a folder of its own, and a manifest says for each part which folder
holds it; a pointer file names the current manifest. Readers thus see a table as of one write, and
other repositories' files, and files of parts that didn't change, are neither read nor written.

Lists of parts pass through the driver: at most buckets for each repository, as in any table that Spark
lists by partitions. Rows never do.
"""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..schema import EDGES, EMBEDDINGS, GRAMS, INDEXED_FILES, KEYS, NODES, RAW_EDGES, SCHEMA_VERSION
from . import postings
from .traverse import ID, scoped

TABLES = {"nodes": NODES, "edges": EDGES, "raw_edges": RAW_EDGES, "embeddings": EMBEDDINGS, "keys": KEYS, "files": INDEXED_FILES, "grams": GRAMS}
#: What a row's bucket hangs on, besides its repository.
DEALT_BY = {"nodes": "file_path", "edges": "file_path", "raw_edges": "file_path", "embeddings": "file_path", "keys": "key", "files": "file_path", "grams": "file_path"}
#: Rows of one value stand together within a part, so that row groups can be skipped.
SORTED_BY = {"nodes": "node_type", "edges": "edge_type", "keys": "key", "grams": "gram"}
UNIQUE = {"nodes": ["repo_id", "node_id"], "edges": ["repo_id", "edge_id"], "raw_edges": ["repo_id", "edge_id", "file_path"], "embeddings": ["repo_id", "node_id"], "files": ["repo_id", "file_path"]}
#: Parts of a repository's table, fixed when a store is made.
BUCKETS = 16
#: Grams of a needle that are counted; any of them prunes, and the rarest one is looked up.
COUNTED_GRAMS = 64
#: Manifests that are kept for open readers, besides the current one.
KEPT_MANIFESTS = 1


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and what of old it doesn't replace."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without those of the files in paths (repo_id, file_path), and edges without those at such a node."""
    nodes, edges, paths = scoped(nodes), scoped(edges), scoped(paths).select("repo_id", "file_path")
    kept = nodes.join(paths, ["repo_id", "file_path"], "left_anti")
    gone = nodes.join(paths, ["repo_id", "file_path"], "left_semi").select(*ID)
    for end in ("src_id", "dst_id"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), ["repo_id", end], "left_anti")
    return kept, edges


def change_set(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(rel_path, change): added, modified or deleted, from two tables (rel_path, content_hash)."""
    a, b = indexed.select("rel_path", F.col("content_hash").alias("was")), current.select("rel_path", F.col("content_hash").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return a.join(b, "rel_path", "full_outer").select("rel_path", change.alias("change")).filter("change is not null")


def repo_part(repo_id: str | None) -> str:
    return hashlib.sha256((repo_id or "").encode()).hexdigest()[:16]


class GraphStore:
    """The tables and a few settings under one path; any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        meta = self._meta()
        found = int(meta.get("schema_version", 0))
        if found > SCHEMA_VERSION:
            warnings.warn(f"the graph has schema version {found}, newer than {SCHEMA_VERSION}", stacklevel=2)
        elif found < SCHEMA_VERSION:
            # Tables up to version 2 weren't in parts; they read as empty, and the next run indexes everything.
            self._set_meta(schema_version=str(SCHEMA_VERSION), buckets=meta.get("buckets", str(buckets)))
        self.buckets = int(self._meta()["buckets"])

    # Small files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _get(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _pairs(self, path: str) -> dict[str, str]:
        return dict(line.split("\t", 1) for line in (self._get(path) or "").splitlines())

    # Parts

    def _number(self, table: str) -> int:
        return int(self._get(f"{self.path}/{table}/current") or 0)

    def manifest(self, table: str, number: int | None = None) -> dict[str, str]:
        """{part: folder that holds it}, of the current manifest unless another is named."""
        return self._pairs(f"{self.path}/{table}/manifest-{self._number(table) if number is None else number}")

    def part(self, table: str, repo_id: Column | None = None, key: Column | None = None) -> Column:
        """The name of a row's part."""
        repo, by = (F.coalesce(c, F.lit("")) for c in (F.col("repo_id") if repo_id is None else repo_id, F.col(DEALT_BY[table]) if key is None else key))
        return F.concat_ws("-", F.substring(F.sha2(repo, 256), 1, 16), F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("string"))

    def parts(self, table: str, rows: DataFrame) -> set[str]:
        """The parts that rows (repo_id and what the table is dealt by) belong to: a list of names on the driver, bounded as said above."""
        return {r.part for r in rows.select(self.part(table).alias("part")).distinct().collect()}

    def repo_parts(self, table: str, repo_id: str) -> set[str]:
        prefix = repo_part(repo_id) + "-"
        return {p for p in self.manifest(table) if p.startswith(prefix)}

    def files(self, table: str) -> dict[str, str]:
        """{data file: its part}, of the current manifest."""
        out = {}
        for part, folder in self.manifest(table).items():
            fs, p = self._fs(f"{self.path}/{table}/{folder}/part={part}")
            out |= {s.getPath().toString(): part for s in fs.listStatus(p)}
        return out

    def table(self, name: str, parts: Iterable[str] | None = None, repo_id: str | None = None) -> DataFrame:
        """A table, or some parts of it, or those of one repository."""
        held = self.manifest(name)
        prefix = None if repo_id is None else repo_part(repo_id) + "-"
        wanted = sorted(p for p in (held if parts is None else set(parts) & set(held)) if prefix is None or p.startswith(prefix))
        if not wanted:
            return self.spark.createDataFrame([], TABLES[name])
        # Columns that an older file lacks read as null: added columns need no rewrite.
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{name}/{held[p]}/part={p}" for p in wanted))

    def merge(self, name: str, df: DataFrame, parts: Iterable[str], folder: str | None = None) -> None:
        """Put df, all rows that these parts are to have, in the place of theirs. No other part is read or written.

        Nodes' trigrams are written along with them, into a folder of the same name: postings count as those
        of a part only where both manifests name one folder.
        """
        number, parts = self._number(name), set(parts)
        folder = folder or f"w{number + 1}-{uuid.uuid4().hex[:8]}"  # a write that failed leaves a folder that no manifest names
        rows = scoped(df).select(*TABLES[name].names).withColumn("part", self.part(name))
        tasks = max(1, min(len(parts), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", *([SORTED_BY[name]] if name in SORTED_BY else []))
        dealt.write.partitionBy("part").parquet(f"{self.path}/{name}/{folder}")
        fs, p = self._fs(f"{self.path}/{name}/{folder}")
        written = {s.getPath().getName().removeprefix("part=") for s in fs.listStatus(p) if s.isDirectory()}
        if written - parts:
            fs.delete(p, True)
            raise ValueError(f"{name}: rows of parts that aren't replaced: {sorted(written - parts)[:3]}")
        if name == "nodes" and written:
            fresh = self.spark.read.schema(NODES).parquet(*(f"{self.path}/nodes/{folder}/part={w}" for w in sorted(written)))
            self.merge("grams", postings.postings(fresh), parts, folder)
        held = {k: v for k, v in self.manifest(name, number).items() if k not in parts} | dict.fromkeys(written, folder)
        self._put(f"{self.path}/{name}/manifest-{number + 1}", "".join(f"{k}\t{v}\n" for k, v in sorted(held.items())))
        self._put(f"{self.path}/{name}/current", str(number + 1))
        self._clean(name, number + 1)

    def _clean(self, name: str, number: int) -> None:
        """Delete what the last manifest that goes named and none that stays does."""
        gone = number - KEPT_MANIFESTS - 1
        if gone < 1:
            return
        kept = [self.manifest(name, n) for n in range(gone + 1, number + 1)]
        for part, folder in self.manifest(name, gone).items():
            if all(m.get(part) != folder for m in kept):
                fs, p = self._fs(f"{self.path}/{name}/{folder}/part={part}")
                fs.delete(p, True)
        for folder in set(self.manifest(name, gone).values()) - {f for m in kept for f in m.values()}:
            fs, p = self._fs(f"{self.path}/{name}/{folder}")
            fs.delete(p, True)
        fs, p = self._fs(f"{self.path}/{name}/manifest-{gone}")
        fs.delete(p, True)

    def containing(self, needle: str, repo_id: str | None = None) -> DataFrame:
        """Nodes whose name or fqn may hold needle, and all that do: those with its rarest trigram, of the parts that have such.

        Parts whose postings aren't of their nodes' last write, and needles shorter than a trigram, are left to a scan.
        """
        held, known = self.manifest("nodes"), self.manifest("grams")
        indexed = {p for p, folder in held.items() if known.get(p) == folder}
        asked = list(dict.fromkeys(needle[i : i + postings.SIZE] for i in range(len(needle) - postings.SIZE + 1)))[:COUNTED_GRAMS]
        if not asked or not indexed:
            return self.table("nodes", repo_id=repo_id)
        scanned = self.table("nodes", set(held) - indexed, repo_id)
        table = self.table("grams", indexed, repo_id)
        counts = dict.fromkeys(asked, 0) | {r.gram: r.n for r in table.filter(F.col("gram").isin(asked)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
        rarest = min(asked, key=counts.get)
        if not counts[rarest]:
            return scanned
        may = scoped(table).filter(F.col("gram") == rarest)
        return scoped(self.table("nodes", self.parts("nodes", may), repo_id)).join(may.select(*ID), ID, "left_semi").unionByName(scoped(scanned))

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    def replace(self, name: str, df: DataFrame, repo_id: str | None = None) -> None:
        """Put df in the place of the whole table, or of one repository's rows, where all of df's are its."""
        held = set(self.manifest(name)) if repo_id is None else self.repo_parts(name, repo_id)
        every = self.parts(name, scoped(df)) if repo_id is None else {f"{repo_part(repo_id)}-{b}" for b in range(self.buckets)}
        self.merge(name, df, held | every)

    def upsert(self, name: str, df: DataFrame) -> None:
        """Rows of df, and what of the table they don't replace. Parts without a row of either aren't rewritten."""
        df, key = scoped(df), UNIQUE[name]
        replaced = self.table(name).select(*dict.fromkeys([*key, DEALT_BY[name]])).join(df.select(*key), key, "left_semi")
        parts = self.parts(name, df) | self.parts(name, replaced)
        self.merge(name, upsert(self.table(name, parts), df, key), parts)

    def delete_files(self, paths: DataFrame) -> None:
        """Drop the nodes, edges and embeddings of files (repo_id, file_path); only parts that hold one of them are rewritten."""
        paths = scoped(paths).select("repo_id", "file_path")
        parts = self.parts("nodes", paths)
        gone = self.table("nodes", parts).join(paths, ["repo_id", "file_path"], "left_semi").select(*ID)
        ends = self.edges.select("repo_id", "file_path", F.explode(F.array("src_id", "dst_id")).alias("node_id"))
        touched = self.parts("edges", ends.join(gone, ID, "left_semi"))
        _, edges = delete_files(self.table("nodes", parts), self.table("edges", touched), paths)
        self.merge("edges", edges, touched)
        for name in ("embeddings", "nodes"):
            self.merge(name, self.table(name, parts).join(paths, ["repo_id", "file_path"], "left_anti"), parts)

    # Settings

    def schema_version(self) -> int:
        return int(self._meta().get("schema_version", 0))

    def _meta(self) -> dict[str, str]:
        return self._pairs(f"{self.path}/meta/settings")

    def _set_meta(self, **values: str) -> None:
        self._put(f"{self.path}/meta/settings", "".join(f"{k}\t{v}\n" for k, v in sorted((self._meta() | values).items())))

    def setting(self, name: str) -> str | None:
        return self._meta().get(name)

    def set_settings(self, **values: str) -> None:
        self._set_meta(**values)

    def node_count(self, node_type: str | None = None) -> int:
        return (self.nodes.filter(F.col("node_type") == node_type) if node_type else self.nodes).count()

    def edge_count(self, edge_type: str | None = None) -> int:
        return (self.edges.filter(F.col("edge_type") == edge_type) if edge_type else self.edges).count()

    def sql(self, query: str, **params) -> DataFrame:
        """SQL over the views nodes and edges, with named parameters."""
        register(self.spark)
        for name in ("nodes", "edges", "embeddings"):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=params)

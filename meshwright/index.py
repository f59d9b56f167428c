"""Indexing: a repository into the stored graph, whole or by its changes.

Unresolved edges and the texts that they and nodes go by are stored along with the graph. An update
lists the folder, reads files whose size or time differ from what was indexed, parses those whose
content does, and resolves the edges that these hold or that name a node which came, went or changed
hands. Parts of tables that hold none of that are neither read nor written, nor is any row of another
repository; the outcome is that of indexing everything.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Workspace
from .operators import delta, enrich, pagerank, resolve, store, vectors
from .parsing import parse
from .schema import EDGES
from .sources import gitlog, repository
from .tables import materialize

#: Failed files whose messages a report carries; it counts them all.
SHOWN_ERRORS = 100
_FILE, _SOURCE, _NODE = ["repo_id", "file_path"], ["repo_id", "src_id"], ["repo_id", "node_id"]


@dataclass
class Report:
    files: int = 0
    nodes: int = 0
    edges: int = 0
    embedded: int = 0
    seconds: float = 0.0
    #: Sources of edges that were resolved again, of an update.
    resolved_sources: int = 0
    #: Files that a parser failed on, and the messages of the first of them.
    failed: int = 0
    errors: list[str] = field(default_factory=list)


class Indexer:
    def __init__(self, spark: SparkSession, config: Config, graph: store.GraphStore | None = None, embedder: vectors.Embedder = vectors.hashed_ngrams, parsers=None):
        self.spark, self.config, self.embedder = spark, config, embedder
        self.store = graph or store.GraphStore(spark, config.db_path)
        self.parsers = parsers or parse.PARSERS

    def scan(self, only=None, contents: bool = True) -> DataFrame:
        c = self.config
        return repository.scan(self.spark, c.repo_path, c.repo_id, exclude=c.exclude_patterns, max_file_size_bytes=c.max_file_size_bytes, only=only, extensions=[e.lower() for e in c.include_extensions], languages=[n.lower() for n in c.languages], contents=contents)

    def _mine(self, name: str, parts=None) -> DataFrame:
        return self.store.table(name, parts, self.config.repo_id)

    def _commits(self) -> DataFrame | None:
        return gitlog.commits(self.spark, self.config.repo_path, self.config.git_history_limit) if self.config.enable_git_enrichment else None

    # Everything

    def run(self, embed: bool = True) -> Report:
        """Index everything; what the repository no longer holds is gone from the graph. Other repositories' rows aren't touched."""
        began, repo = time.time(), self.config.repo_id
        # Files are written last: they tell what has been indexed, so a run or update cut short begins anew.
        if self.store.repo_parts("files", repo):
            self.store.replace("files", self._mine("files").limit(0), repo)
        parsed = materialize(parse.parse_files(self.scan(), self.parsers))
        nodes = materialize(enrich.enrich(resolve.dedupe_nodes(parse.nodes_of(parsed)), self._commits()))
        self.store.replace("raw_edges", parse.raw_edges_of(parsed), repo)
        raw = self._mine("raw_edges")
        self.store.replace("keys", delta.keys_of(nodes, raw), repo)
        resolved = materialize(resolve.resolve_edges(raw, nodes))
        self._ranks_due(True)
        self.store.replace("edges", self._linked(resolved, nodes), repo)
        self.store.replace("nodes", pagerank.with_importance(nodes, self._mine("edges")), repo)
        report = self._report(parsed)
        if embed:
            report.embedded = self._embed(self._mine("nodes"), lambda made: self.store.replace("embeddings", made, repo))
        self._ranks_due(False)
        self.store.replace("files", parsed.withColumnRenamed("rel_path", "file_path"), repo)
        report.seconds = time.time() - began
        return report

    @staticmethod
    def _linked(resolved: DataFrame, types: DataFrame) -> DataFrame:
        """Edges of the graph, those from tests to what they test among them."""
        both = resolved.unionByName(resolve.tested_by(resolved, types), allowMissingColumns=True)
        return resolve.dedupe_edges(resolve.valid_pairs(both, types)).select(*EDGES.names)

    def _embed(self, nodes: DataFrame, put) -> int:
        made = materialize(vectors.embed(nodes, self.embedder, self.config.embedding_batch_size, self.config.embed_limit))
        put(made)
        return made.count()

    def _report(self, parsed: DataFrame) -> Report:
        n, failed = parsed.agg(F.count("*"), F.count(F.when(F.size("errors") > 0, 1))).first()
        report = Report(files=n, nodes=self.store.node_count(), edges=self.store.edge_count(), failed=failed)
        if failed:
            broken = parsed.filter(F.size("errors") > 0).select("rel_path", "errors").orderBy("rel_path").limit(SHOWN_ERRORS)
            report.errors = [f"{r.rel_path}: {e}" for r in broken.collect() for e in r.errors]
        return report

    def _ranks_due(self, due: bool | None = None) -> bool:
        """Whether edges have been written whose ranks haven't been, as when an update was cut short; or say so."""
        name = f"ranks_due-{store.repo_part(self.config.repo_id)}"
        if due is not None and due != (self.store.setting(name) == "1"):
            self.store.set_settings(**{name: "1" if due else "0"})
        return self.store.setting(name) == "1"

    # Changes

    def _compared(self, verify: bool = False) -> DataFrame:
        """(rel_path, change, and FILES columns of what was read): files whose size or time differs from what was indexed, and gone ones.

        change is null where the content turns out to be the same. verify: read all files, whatever their size and time.
        """
        listed = self.scan(contents=False).filter(F.col("language").isin(*self.parsers)).withColumn("listed", F.lit(True))
        known = self._mine("files").select(F.col("file_path").alias("rel_path"), F.col("content_hash").alias("was"), F.col("size_bytes").alias("was_size"), F.col("modified_ns").alias("was_ns"))
        same = F.lit(not verify) & F.col("was_size").eqNullSafe(F.col("size_bytes")) & F.col("was_ns").eqNullSafe(F.col("modified_ns"))
        differs = listed.join(known, "rel_path", "full_outer").filter(~same | F.col("listed").isNull()).drop("was_size", "was_ns")
        read = repository.read_contents(differs.withColumn("listed", F.coalesce("listed", F.lit(False))), self.config.repo_path)
        change = F.when(F.col("content_hash").isNull(), F.when(F.col("was").isNotNull(), "deleted")).when(F.col("was").isNull(), "added").when(F.col("was") != F.col("content_hash"), "modified")
        return read.withColumn("change", change)

    def changes(self, verify: bool = False) -> DataFrame:
        """(rel_path, change) between the index and the folder, under the same filters as a scan."""
        return self._compared(verify).filter("change is not null").select("rel_path", "change")

    def update(self, embed: bool = True, verify: bool = False) -> Report:
        """Bring the graph up to date with the files that changed."""
        began, repo = time.time(), self.config.repo_id
        if not self.store.repo_parts("files", repo):
            return self.run(embed)
        compared = materialize(self._compared(verify))
        n_changed, n_read = compared.agg(F.count("change"), F.count("*")).first()
        if n_changed:
            report = self._apply(compared.filter("change is not null"), embed)
        else:
            report = Report(nodes=self.store.node_count(), edges=self.store.edge_count())
        if n_read:
            seen = compared.select(F.lit(repo).alias("repo_id"), F.col("rel_path").alias("file_path"), "size_bytes", "modified_ns", "content_hash")
            parts = self.store.parts("files", seen)
            self.store.merge("files", store.upsert(self._mine("files", parts), seen, _FILE).filter("content_hash is not null"), parts)
        report.seconds = time.time() - began
        return report

    def _apply(self, changed: DataFrame, embed: bool) -> Report:
        """The changed files' rows in the place of the old ones, and edges of other files that these concern."""
        repo, table = self.config.repo_id, self.store
        parsed = materialize(parse.parse_files(changed.filter("change <> 'deleted'"), self.parsers))
        stale = changed.select(F.lit(repo).alias("repo_id"), F.col("rel_path").alias("file_path"))
        parts = table.parts("nodes", stale)  # of files; tables that are dealt by file have the same

        held = self._mine("nodes", parts)
        new, old = resolve.dedupe_nodes(parse.nodes_of(parsed)), held.join(stale, _FILE, "left_semi")
        raw, held_raw = parse.raw_edges_of(parsed), self._mine("raw_edges", parts)
        old_raw = held_raw.join(stale, _FILE, "left_semi")
        # Edges are resolved by source, since what a test tests hangs on all its calls.
        rewritten = delta.sources_rewritten(old_raw, raw, old, new).select("repo_id", F.lit("source").alias("role"), F.col("src_id").alias("key"))
        concerns = materialize(rewritten.unionByName(delta.affected_references(old, new)))
        n_sources, same = 0, True
        if not concerns.isEmpty():
            n_sources, same = self._resolve(stale, parts, concerns, new, raw)
            self._merge_keys(stale, delta.keys_of(old, old_raw), delta.keys_of(new, raw))
        if not delta.differing(old_raw, raw.select(*old_raw.columns)).isEmpty():
            table.merge("raw_edges", held_raw.join(stale, _FILE, "left_anti").unionByName(raw), parts)

        # Nodes of changed files, those whose history differs, and, where links do, all whose rank has moved.
        commits = self._commits()
        known = self._mine("nodes")
        history = self._history_differs(known, commits)
        node_parts = parts | (table.parts("nodes", history) if history is not None else set())
        nodes = new.unionByName(self._mine("nodes", node_parts).join(stale, _FILE, "left_anti"))
        if self._ranks_due() or not same:
            ranks = materialize(pagerank.pagerank(pagerank.ranked_links(self._mine("edges"))))
            node_parts = node_parts | table.parts("nodes", self._moved(known, ranks))
            nodes = new.unionByName(self._mine("nodes", node_parts).join(stale, _FILE, "left_anti"))
            ranked = pagerank.with_ranks(enrich.enrich(nodes, commits), ranks)
        else:
            ranked = pagerank.with_ranks(enrich.enrich(nodes, commits), known.select(*_NODE, F.col("centrality_score").alias("rank")) if node_parts != parts else held.select(*_NODE, F.col("centrality_score").alias("rank")))
        table.merge("nodes", ranked, node_parts)
        self._ranks_due(False)

        report = self._report(parsed)
        report.resolved_sources = n_sources
        kept = self._mine("embeddings", parts).join(stale, _FILE, "left_anti")
        if not embed:
            table.merge("embeddings", kept, parts)
        else:
            fresh_nodes = self._mine("nodes", parts).join(stale, _FILE, "left_semi")
            report.embedded = self._embed(fresh_nodes, lambda made: table.merge("embeddings", kept.unionByName(made), parts))
        return report

    def _resolve(self, stale: DataFrame, parts: set[str], concerns: DataFrame, new: DataFrame, raw: DataFrame) -> tuple[int, bool]:
        """Edges of the sources that a change concerns, resolved again: (number of these, whether ranked links are as before)."""
        table = self.store
        keys = concerns.filter("role <> 'source'")
        key_parts = table.parts("keys", keys)
        named = self._mine("keys", key_parts).join(keys, ["repo_id", "role", "key"], "left_semi").select(*_FILE).distinct()
        naming = materialize(named.join(stale, _FILE, "left_anti")) if key_parts else named
        named_parts = table.parts("raw_edges", naming) if key_parts else set()
        every = self._mine("raw_edges", named_parts).join(naming, _FILE, "left_semi").unionByName(raw) if named_parts else raw
        own = concerns.filter("role = 'source'").select("repo_id", F.col("key").alias("src_id"))
        sources = materialize(own.unionByName(delta.sources_naming(every, keys)).distinct())
        n_sources, edge_parts = sources.count(), parts | named_parts
        if not n_sources:
            return 0, True
        again = every.join(sources, _SOURCE, "left_semi")
        mine = new.unionByName(self._mine("nodes", edge_parts).join(stale, _FILE, "left_anti")).join(sources.withColumnRenamed("src_id", "node_id"), _NODE, "left_semi")
        needed = materialize(resolve.tries(again.select("repo_id", "dst_ref", resolve.import_base(again).alias("base")).distinct()).select("repo_id", "role", "key").distinct())
        defined = self._mine("keys", table.parts("keys", needed)).filter(F.col("role").isin(*delta.DEFINES)).join(stale, _FILE, "left_anti")
        defined = defined.unionByName(delta.defined(new)).join(needed, ["repo_id", "role", "key"], "left_semi")
        resolved = materialize(resolve.resolve_with(again, mine.select("repo_id", F.col("node_id").alias("src_id")), defined))
        types = mine.select(*_NODE, "node_type").unionByName(resolved.select("repo_id", F.col("dst_id").alias("node_id"), F.col("dst_type").alias("node_type"))).distinct()
        before = self._mine("edges", edge_parts)
        fresh = materialize(delta.without_owners(before, sources).unionByName(self._linked(resolved.drop("dst_type"), types)))
        same = pagerank.same_links(before, fresh)
        if not same:
            self._ranks_due(True)
        table.merge("edges", fresh, edge_parts)
        return n_sources, same

    def _merge_keys(self, stale: DataFrame, old: DataFrame, new: DataFrame) -> None:
        """Only parts whose texts came or went are rewritten, though a changed file's texts are in many."""
        parts = self.store.parts("keys", delta.differing(old, new))
        if parts:
            fresh = new.filter(self.store.part("keys").isin(*parts))
            self.store.merge("keys", self._mine("keys", parts).join(stale, _FILE, "left_anti").unionByName(fresh), parts)

    @staticmethod
    def _history_differs(known: DataFrame, commits: DataFrame | None) -> DataFrame | None:
        """(repo_id, file_path) of indexed files whose change frequency or last commit isn't that of the log."""
        if commits is None:
            return None
        files = known.filter("node_type = 'File'").select(*_FILE, "change_frequency", "last_modified_commit")
        found = enrich.file_history(commits).select("file_path", F.col("change_frequency").alias("f"), F.col("last_modified_commit").alias("c"))
        differs = ~F.col("change_frequency").eqNullSafe(F.coalesce("f", F.lit(0.0))) | ~F.col("last_modified_commit").eqNullSafe(F.coalesce("c", "last_modified_commit"))
        return files.join(found, "file_path", "left").filter(differs).select(*_FILE)

    @staticmethod
    def _moved(known: DataFrame, ranks: DataFrame) -> DataFrame:
        """(repo_id, file_path) of nodes whose centrality isn't their rank."""
        both = known.select(*_FILE, "node_id", "centrality_score").join(ranks, _NODE, "left")
        return both.filter(~F.col("centrality_score").eqNullSafe(F.coalesce("rank", F.lit(0.0)))).select(*_FILE)


def index_workspace(spark: SparkSession, workspace: Workspace, repo_id: str | None = None, **options) -> dict[str, Report]:
    """Index one repository of a workspace, or all, into its shared store. Each reads and writes its own parts alone."""
    graph = store.GraphStore(spark, str(workspace.db_path))
    chosen = [workspace.get(repo_id)] if repo_id else workspace.repos
    return {r.id: Indexer(spark, Config(repo_path=str(r.path), repo_id=r.id, db_path=str(workspace.db_path)), graph).run(**options) for r in chosen}

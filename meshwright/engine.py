"""The query engine: every way to ask, one shape of answer."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import questions
from .config import Config
from .functions import text as fn
from .operators import find, packing, ranking, review, store, traverse, vectors
from .plans import dsl
from .sources import diffs
from .tables import materialize

SHOWN = ("node_id", "fqn", "name", "node_type", "file_path", "language", "start_line", "end_line", "score")
_RELATED = "array<struct<edge_type:string,dst_name:string>>"


@dataclass
class Result:
    """What a query found. rows holds one page, so it lives on the driver."""

    query: str
    intent: str
    rows: list[dict] = field(default_factory=list)
    context: str = ""
    paths: list[list[str]] = field(default_factory=list)
    error: str | None = None

    def as_dict(self) -> dict:
        nodes = [{k: round(r[k], 4) if k == "score" else r.get(k) for k in SHOWN} for r in self.rows]
        return {"query": self.query, "intent": self.intent, "nodes": nodes, "paths": self.paths, "node_count": len(nodes), "error": self.error}


@dataclass
class ReviewBundle:
    context_text: str
    nodes: list[dict]
    estimated_tokens: int
    budget_tokens: int
    seeds: list[dict]
    dropped_count: int = 0
    notes: list[str] = field(default_factory=list)
    baseline_tokens: int = 0
    tokens_saved: int = 0

    def to_dict(self) -> dict:
        return asdict(self) | {"nodes": [n | {"score": round(n["score"], 4)} for n in self.nodes]}


class QueryEngine:
    def __init__(self, spark: SparkSession, config: Config, graph: store.GraphStore | None = None, embedder: vectors.Embedder = vectors.hashed_ngrams, translate: questions.Translator | None = None):
        self.spark, self.config, self.embedder, self.translate = spark, config, embedder, translate
        self.store = graph or store.GraphStore(spark, config.db_path)

    def __enter__(self) -> QueryEngine:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; tables are read as they are asked for."""

    # Answers

    def _related(self, ids: DataFrame) -> DataFrame:
        """(repo_id, node_id, related): up to five outgoing edges of each result row."""
        out = traverse.scoped(self.store.edges).join(ids.select("repo_id", F.col("node_id").alias("src_id")), ["repo_id", "src_id"], "left_semi")
        named = out.join(traverse.scoped(self.store.nodes).select("repo_id", F.col("node_id").alias("dst_id"), F.col("name").alias("dst_name")), ["repo_id", "dst_id"])
        first = W.partitionBy("repo_id", "src_id").orderBy("edge_type", "dst_name", "dst_id")
        few = named.withColumn("_n", F.row_number().over(first)).filter("_n <= 5")
        return few.groupBy("repo_id", F.col("src_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "edge_type", "dst_name"))), lambda e: F.struct(e.edge_type.alias("edge_type"), e.dst_name.alias("dst_name"))).alias("related"))

    def _answer(self, query: str, intent: str, found: DataFrame, terms: list[str] | None = None, ranked: bool = True, max_tokens: int | None = None) -> Result:
        if "semantic_score" not in found.columns:
            found = found.withColumn("semantic_score", F.lit(0.0))
        words = F.array(*map(F.lit, terms)) if terms else None
        scored = ranking.rank(found, words) if ranked else ranking.rank(found, words).withColumn("position", F.row_number().over(W.orderBy("input_rank")))
        page = materialize(traverse.scoped(scored))  # at most a page of rows
        related = page.join(self._related(page), traverse.ID, "left").withColumn("related", F.coalesce("related", F.array().cast(_RELATED)))
        block = fn.node_block(*(F.col(c) for c in ("node_type", "fqn", "signature", "docstring", "file_path", "start_line", "end_line", "related")))
        blocks = materialize(related.select("position", block.alias("block")))
        packed = packing.pack_prefix(blocks, max_tokens or self.config.context_max_tokens, query)
        rows = [r.asDict() for r in page.orderBy("position").collect()]
        result = Result(query, intent, rows, packing.packed_text(packed, query))
        result.blocks = blocks
        if "path_no" in page.columns:
            paths: dict[int, list[str]] = {}
            for r in rows:
                paths.setdefault(r["path_no"], []).append(r["fqn"])
            result.paths = list(paths.values())
        return result

    def query_dsl(self, text: str, repo_id: str | None = None) -> Result:
        try:
            tree = dsl.parse(text)
            held = find.needle(tree.filters) if isinstance(tree, dsl.Find) else None
            nodes = self.store.containing(held, self._repo(repo_id)) if held else self.store.nodes
            found = dsl.execute(tree, nodes, self.store.edges, self._repo(repo_id), self.config.default_top_k, self._path_depth())
            return self._answer(text, "structural", found, ranked=not isinstance(tree, dsl.Path))
        except (ValueError, TypeError) as e:
            return Result(text, "structural", error=str(e))

    def _near(self, text: str, top_k: int, where: dict) -> DataFrame:
        (probe,) = self.embedder([text])
        hits = vectors.search(self.store.table("embeddings"), probe, top_k, where).select("repo_id", "node_id", F.greatest(F.col("score"), F.lit(0.0)).alias("semantic_score"))
        found = hits.join(self.store.nodes, ["repo_id", "node_id"])
        return found.withColumn("input_rank", F.row_number().over(W.orderBy(F.desc("semantic_score"), "node_id")))  # a page

    def query_semantic(self, text: str, top_k: int | None = None, repo_id: str | None = None, node_type: str | None = None, language: str | None = None) -> Result:
        where = {"repo_id": repo_id or self.config.repo_id, "node_type": node_type, "language": language}
        found = self._near(text, top_k or self.config.default_top_k, {k: v for k, v in where.items() if v})
        return self._answer(text, "semantic", found, text.split())

    def query_hybrid(self, text: str, top_k: int | None = None, repo_id: str | None = None) -> Result:
        k, repo = top_k or self.config.default_top_k, repo_id or self.config.repo_id
        graph = find.find(self.store.nodes, None, (), k, repo or None)
        by_graph = graph.select(*traverse.ID, F.row_number().over(W.orderBy(F.desc("importance_score"), "node_id")).alias("rank"), F.lit(0.0).alias("semantic_score"))
        near = self._near(text, k, {"repo_id": repo} if repo else {}).select(*traverse.ID, F.col("input_rank").alias("rank"), "semantic_score")
        fused = materialize(ranking.fuse(by_graph, near, k))
        found = fused.join(traverse.scoped(self.store.nodes), traverse.ID).withColumn("input_rank", F.row_number().over(W.orderBy(F.desc("rrf"), "node_id")))
        result = self._answer(text, "hybrid", found, text.split())
        return result if result.rows else Result(text, "hybrid", error="neither the graph nor the vectors hold anything")

    def query_impact(self, target: str, depth: int = 3, repo_id: str | None = None) -> Result:
        try:
            found = dsl._numbered(traverse.dependents(self.store.nodes, self.store.edges, target, depth, self.config.default_top_k, self._repo(repo_id)))
        except (ValueError, TypeError) as e:
            return Result(target, "impact", error=str(e))
        return self._answer(target, "impact", found)

    def query_path(self, src: str, dst: str, max_depth: int | None = None, repo_id: str | None = None) -> Result:
        label = f"{src} → {dst}"
        try:
            found = dsl.path_nodes(self.store.nodes, self.store.edges, src, dst, traverse.checked_depth(self._path_depth() if max_depth is None else max_depth, 1, traverse.MAX_PATH), self._repo(repo_id))
        except (ValueError, TypeError) as e:
            return Result(label, "path", error=str(e))
        return self._answer(label, "path", found, ranked=False)

    def query_nl(self, question: str, repo_id: str | None = None) -> Result:
        nodes, repo = self.store.nodes, self._repo(repo_id)
        kind, text = questions.build(self.spark, nodes.filter(F.col("repo_id") == repo) if repo else nodes, question, self.translate)
        result = self.query_semantic(question, repo_id=repo_id) if kind == "semantic" or not text else self.query_dsl(text, repo_id)
        result.query, result.intent = question, kind
        return result

    def neighbourhood(self, target: str, depth: int = 2, repo_id: str | None = None) -> Result:
        return self._answer(target, "structural", dsl._numbered(traverse.neighbourhood(self.store.nodes, self.store.edges, target, depth, self.config.default_top_k, self._repo(repo_id))))

    def _path_depth(self) -> int:
        """Hops of a PATH query that names no depth."""
        return min(dsl.PATH_DEPTH, self.config.max_call_depth)

    def _repo(self, repo_id: str | None) -> str | None:
        return repo_id or self.config.repo_id or None

    def pack_context(self, result: Result, max_tokens: int | None = None) -> str:
        """The same answer packed for another budget."""
        return packing.packed_text(packing.pack_prefix(result.blocks, max_tokens or self.config.context_max_tokens, result.query), result.query) if result.rows else result.context

    # Reviews

    def review(self, diff: str, token_budget: int = 4000, model: str = "claude", number: int | None = None, title: str = "", impact_depth: int = 2, per_seed: int = review.PER_SEED, include=tuple(review.REASON_WEIGHT)[1:]) -> ReviewBundle:
        """A budgeted context for the reviewer of a diff."""
        nodes, edges = traverse.scoped(self.store.nodes), traverse.scoped(self.store.edges)
        if self.config.repo_id:  # a node without a repository fits any
            nodes, edges = (t.filter(F.col("repo_id").isin("", self.config.repo_id)) for t in (nodes, edges))
        changed = diffs.parse_diff(diff)
        touched = materialize(review.seeds(diffs.hunks(self.spark, diff), nodes).join(nodes.select(*traverse.ID, "tags"), traverse.ID))
        if touched.isEmpty():
            return ReviewBundle("", [], 0, token_budget, [], notes=["no touched symbol is in the index; is it up to date?"])
        near = review.expand(touched, nodes, edges, impact_depth, per_seed, include)
        every = near.unionByName(touched.select(*traverse.ID, F.lit("touched").alias("reason"), F.lit(0).alias("distance"))).join(nodes, traverse.ID)
        tag = F.concat(F.lit("[selected as: "), "reason", F.lit(", distance="), F.col("distance").cast("string"), F.lit("]"))
        none = F.array().cast(_RELATED)
        plain = fn.node_block(F.col("node_type"), F.col("fqn"), F.col("signature"), F.col("docstring"), F.col("file_path"), F.col("start_line"), F.col("end_line"), none)
        tagged = fn.node_block(F.col("node_type"), F.col("fqn"), F.lit(""), tag, F.col("file_path"), F.col("start_line"), F.col("end_line"), none)
        scored = materialize(every.select(*traverse.ID, "fqn", "node_type", "file_path", "start_line", "end_line", "reason", "distance",
                                          review.score(F.col("reason"), F.col("distance"), F.col("importance_score")).alias("score"), F.length(plain).alias("chars"), tagged.alias("block")))
        kept = review.trim(scored, token_budget, model).orderBy(F.col("reason") != "touched", F.desc("score"), "node_id").collect()
        seeds = [r for r in kept if r.reason == "touched"]
        label = f"{f'PR #{number}' if number is not None else 'PR (no number)'} — {title or '(untitled)'} — {len(seeds)} touched symbol(s)"
        context = packing.header(label) + packing.SEPARATOR.join(r.block for r in kept)
        estimate = lambda n: self.spark.range(1).select(fn.estimate_tokens(F.lit(n), model)).first()[0]
        tokens, baseline = estimate(len(context)), self._baseline(changed, model)
        listed = [{k: r[k] for k in ("node_id", "fqn", "node_type", "file_path", "start_line", "end_line", "score", "reason", "distance")} for r in kept]
        return ReviewBundle(context, listed, tokens, token_budget, [{"fqn": r.fqn, "node_type": r.node_type} for r in seeds], scored.count() - len(kept), [], baseline, max(0, baseline - tokens))

    def _baseline(self, changed: list[diffs.ChangedFile], model: str) -> int:
        """Tokens of all changed files whole; what is deleted or can't be read counts nothing."""
        sizes = []
        for f in changed:
            if not f.is_deleted:
                try:
                    sizes.append((len((Path(self.config.repo_path) / f.path).read_text(errors="replace")),))
                except OSError:
                    continue
        if not sizes:
            return 0
        return self.spark.createDataFrame(sizes, "n int").agg(F.sum(fn.estimate_tokens(F.col("n"), model).cast("bigint"))).first()[0]

"""The registered queries over the test tables, each an operator applied to whole tables, with DuckDB SQL.

NODES and EDGES in the SQL texts stand for the derived graph, which both engines build from the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testgraph
from .functions import text as fn
from .operators import enrich, find, packing, pagerank, postings, ranking, resolve, review, store, traverse, vectors
from .plans import dsl
from .tables import counts_by, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NODES = f"nodes AS ({testgraph.nodes_sql('[{}]')})"
EDGES = f"edges AS MATERIALIZED ({testgraph.EDGES_SQL})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the derived graph as one repository's."""
    return testgraph.nodes(spark, sf_dir).withColumn("repo_id", F.lit("")), testgraph.edges(spark, sf_dir)


def r6(c) -> F.Column:
    return F.round(c, 6)


# Scans and scalar functions


@query("SELECT doc_id, lang, length(text)::BIGINT AS size FROM documents WHERE length(text) <= 5000 AND lang IN ('en', 'de')")
def scan_size_lang_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter((F.length("text") <= 5000) & F.col("lang").isin("en", "de")).select("doc_id", "lang", F.length("text").cast("bigint").alias("size"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT o_orderkey, substr(sha256('orders/' || (o_orderkey % 40)::VARCHAR || ':o' || o_orderkey::VARCHAR), 1, 16) AS node_id FROM orders")
def node_ids(spark, sf):
    o = table(spark, sf, "orders")
    path = F.concat(F.lit("orders/"), (F.col("o_orderkey") % 40).cast("string"))
    return o.select("o_orderkey", fn.node_id(path, F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("node_id"))


@query(f"WITH {EDGES} SELECT src_id, dst_id, edge_type, substr(sha256(src_id || ':' || edge_type || ':' || dst_id), 1, 16) AS edge_id FROM edges")
def edge_ids(spark, sf):
    return testgraph.edges(spark, sf).select("src_id", "dst_id", "edge_type", fn.edge_id(F.col("src_id"), F.col("edge_type"), F.col("dst_id")).alias("edge_id"))


@query("""WITH e AS (SELECT doc_id, ['.py', '.ts', '.jsx', '.JSON', '.yml', '.toml', '.md', '.txt'][1 + doc_id % 8] AS ext FROM documents)
SELECT doc_id, lower(ext) AS extension, CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.jsx' THEN 'javascript'
 WHEN '.json' THEN 'json' WHEN '.yml' THEN 'yaml' WHEN '.toml' THEN 'toml' WHEN '.md' THEN 'markdown' ELSE 'unknown' END AS language FROM e""")
def language_map(spark, sf):
    exts = F.array(*map(F.lit, (".py", ".ts", ".jsx", ".JSON", ".yml", ".toml", ".md", ".txt")))
    path = F.concat(F.lit("src/mod"), F.col("doc_id").cast("string"), F.element_at(exts, (1 + F.col("doc_id") % 8).cast("int")))
    ext = fn.extension(path)
    return table(spark, sf, "documents").select("doc_id", ext.alias("extension"), fn.language(ext).alias("language"))


@query(r"SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '^.*/1.*$') OR regexp_matches(url, '^(.*/)?[^/]*9$'))")
def glob_exclude(spark, sf):
    from .sources.repository import glob_regex

    excluded = F.col("url").rlike(glob_regex(["*/1*"])) | F.substring_index("url", "/", -1).rlike(glob_regex(["*9"]))
    return table(spark, sf, "pages").filter(~excluded).select("page_id", "url")


_TAGS_SQL = ", ".join(f"CASE WHEN regexp_matches(u, '(?i){p}') THEN '{t}' END" for p, t in fn.TAG_RULES)


@query(f"WITH t AS (SELECT page_id, url || ' ' || html AS u FROM pages), a AS (SELECT page_id, list_filter([{_TAGS_SQL}], lambda x: x IS NOT NULL) AS l FROM t) SELECT page_id, coalesce(array_to_string(l, ','), '') AS tags FROM a")
def auto_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(fn.auto_tags(F.concat_ws(" ", "url", "html")), ",").alias("tags"))


@query("WITH e AS (SELECT user_id::VARCHAR AS file_path, event_id FROM events) SELECT file_path, round(count(DISTINCT event_id) / (SELECT count(DISTINCT event_id) FROM e)::DOUBLE, 9) AS change_frequency FROM e GROUP BY 1")
def change_frequency(spark, sf):
    return _history(spark, sf).select("file_path", F.round("change_frequency", 9).alias("change_frequency"))


@query("SELECT user_id::VARCHAR AS file_path, substr(arg_min(sha256(event_id::VARCHAR), event_id), 1, 8) AS last_modified_commit FROM events GROUP BY 1")
def last_commit(spark, sf):
    return _history(spark, sf).select("file_path", "last_modified_commit")


def _history(spark, sf):
    e = table(spark, sf, "events")
    return enrich.file_history(e.select(F.col("event_id").alias("commit_idx"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("sha"), F.col("user_id").cast("string").alias("file_path")))


@query("SELECT doc_id, greatest(1, floor(length(text) / 3.5)::INT) AS plain, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4.0)::INT) END AS gpt, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)::INT) END AS claude FROM documents")
def token_estimate(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", fn.estimate_tokens(n).alias("plain"), fn.estimate_tokens(n, "GPT-large").alias("gpt"), fn.estimate_tokens(n, "claude-x").alias("claude"))


@query("SELECT doc_id, CASE WHEN length(text) > 512 THEN substr(text, 1, 511) || '…' ELSE text END AS short FROM documents")
def truncate_doc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.truncate(F.col("text")).alias("short"))


@query(f"WITH {NODES} SELECT node_id, node_type || ': ' || fqn || CASE WHEN docstring <> '' THEN chr(10) || 'Doc: ' || substr(docstring, 1, 300) ELSE '' END || CASE WHEN coalesce(file_path, '') <> '' THEN chr(10) || 'File: ' || file_path ELSE '' END AS document FROM nodes")
def embedding_doc(spark, sf):
    return testgraph.nodes(spark, sf).select("node_id", fn.embedding_document(F.col("node_type"), F.col("fqn"), F.col("docstring"), F.col("file_path")).alias("document"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS listed FROM events")
def json_lists(spark, sf):
    as_list = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.lit('["a", "b"]'))
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.size(fn.parse_list(as_list)).alias("listed"))


# Questions whose intents are known.
GOLDEN_QUESTIONS = (
    "How does authentication flow through the app?", "path from login to database", "What breaks if I change UserService?", "What depends on FeatureFlagManager?",
    "callers of authenticate", "What calls the login function?", "which files import auth?", "where is authenticate defined?", "Show me payment processing code", "retry logic implementation",
)
_ANY = {k: " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in v) for k, v in fn.INTENT_RULES.items()}
_QUESTIONS = "SELECT q FROM (VALUES " + ", ".join(f"('{q}')" for q in GOLDEN_QUESTIONS) + ") v(q) UNION ALL SELECT text AS q FROM conversations"


@query(f"WITH t AS ({_QUESTIONS}) SELECT q, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _ANY.items()) + " ELSE 'semantic' END AS intent FROM t")
def intent_classify(spark, sf):
    testgraph.views(spark, sf, "conversations")
    return spark.sql(_QUESTIONS).select("q", fn.intent(F.col("q")).alias("intent"))


@query(f"""WITH {NODES}, q AS (SELECT 'What calls Customer_' || c_custkey::VARCHAR || ' and ' || c_name || '?' AS q, c_custkey FROM customer),
t AS (SELECT c_custkey, unnest(list_concat(regexp_extract_all(q, '\\b([A-Z][a-z]+[A-Za-z0-9]*|[a-z]+_[a-z_]+[a-z0-9]*)\\b', 1), ['o' || c_custkey::VARCHAR])) AS cand FROM q)
SELECT DISTINCT c_custkey, fqn FROM t JOIN nodes ON name = cand""")
def entity_exact(spark, sf):
    nodes = testgraph.nodes(spark, sf)
    key = F.col("c_custkey").cast("string")
    q = F.concat(F.lit("What calls Customer_"), key, F.lit(" and "), F.col("c_name"), F.lit("? See 'o"), key, F.lit("'"))
    cands = table(spark, sf, "customer").select("c_custkey", F.explode(fn.symbol_candidates(q)).alias("name"))
    return cands.join(nodes.select("name", "fqn"), "name").select("c_custkey", "fqn").distinct()


# Finding


def _page(df: DataFrame) -> DataFrame:
    return df.select("node_id", "node_type", "name", "fqn", r6("importance_score").alias("importance_score"))


_PAGE = "SELECT node_id, node_type, name, fqn, round(importance_score, 6) AS importance_score FROM nodes WHERE {} ORDER BY importance_score DESC, node_id LIMIT {}"


def _found(name: str, dsl_text: str, where: str, limit: int = 20, repo: str | None = None):
    def f(spark, sf):
        return _page(dsl.execute(dsl_text, testgraph.nodes(spark, sf), testgraph.edges(spark, sf), repo))

    f.__name__ = name
    # Order by the exact score, then round: the inner query picks the rows.
    inner = f"SELECT * FROM nodes WHERE {where} ORDER BY importance_score DESC, node_id LIMIT {limit}"
    query(f"WITH {NODES}, p AS ({inner}) SELECT node_id, node_type, name, fqn, round(importance_score, 6) AS importance_score FROM p")(f)


_found("find_type_topk", "FIND function LIMIT 50", "node_type = 'Function'", 50)
_found("find_name_eq", "FIND WHERE name = o77", "name = 'o77'")
_found("find_name_contains", 'FIND model WHERE name contains "ring" LIMIT 20', "node_type = 'DbModel' AND contains(name, 'ring')")
_found("find_tag", "FIND class WHERE tag = BUILDING", "node_type = 'Class' AND list_contains(tags, 'BUILDING')")
_found("find_file_and_language", 'find * where file ~ "orders/p7" and language = python limit 30', "contains(file_path, 'orders/p7') AND language = 'python'", 30)
_found("find_repo_scope", "FIND interface WHERE fqn ~ Supplier LIMIT 15", "node_type = 'Interface' AND contains(fqn, 'Supplier') AND repo_id = 'repo1'", 15, "repo1")
_found("find_default_limit", "FIND * WHERE nonsense = 3 LIMIT 0", "TRUE")


@query(f"""WITH {NODES}, t(target) AS (VALUES ('o77'), ('orders.o78'), ('parts.'), ('s3'), ('no such symbol')),
r AS (SELECT target, node_id, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN fqn = target THEN 0 WHEN node_id = target THEN 1 WHEN name = target THEN 2 ELSE 3 END, importance_score DESC, node_id) AS n
 FROM t JOIN nodes ON contains(fqn, target) OR contains(name, target) OR node_id = target)
SELECT target, node_id FROM t LEFT JOIN (SELECT target, node_id FROM r WHERE n = 1) USING (target)""")
def resolve_target(spark, sf):
    nodes = testgraph.nodes(spark, sf)
    rows = [(t, traverse.resolve(nodes, t)) for t in ("o77", "orders.o78", "parts.", "s3", "no such symbol")]
    return spark.createDataFrame(rows, "target string, node_id string")


@query(f"""WITH {NODES}, t AS (SELECT unnest(string_split(p_name, ' ')) AS needle FROM part UNION SELECT n_name FROM nation UNION SELECT left(n_name, 2) FROM nation)
SELECT needle, node_id FROM t JOIN nodes ON contains(name, needle) OR contains(fqn, needle) WHERE needle <> ''""")
def contains_by_postings(spark, sf):
    """Every node whose name or fqn holds a word of a part's name, a nation's name or the first two letters of one."""
    nodes = graph(spark, sf)[0]
    nations = table(spark, sf, "nation")
    needles = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("needle")).unionByName(nations.select(F.col("n_name").alias("needle"))).unionByName(nations.select(F.left("n_name", F.lit(2)).alias("needle")))
    return postings.containing(nodes, materialize(postings.postings(nodes)), needles).select("needle", "node_id")


def _neighbours(name: str, kind: str, ids: str, edge_type: str, near: str, far: str):
    def f(spark, sf):
        nodes, edges = graph(spark, sf)
        return getattr(find, kind)(nodes, edges, nodes.filter(ids), testgraph.most_edges(spark, sf, edge_type)).select("anchor", "node_id", "name")

    f.__name__ = name
    query(f"WITH {NODES}, {EDGES} SELECT DISTINCT {near} AS anchor, n.node_id, n.name FROM edges JOIN nodes n ON n.node_id = {far} WHERE edge_type = '{edge_type}' AND src_id <> dst_id AND {near} IN (SELECT node_id FROM nodes WHERE {ids})")(f)


_neighbours("callers", "callers", "node_type = 'Interface'", "CALLS", "dst_id", "src_id")
_neighbours("callees", "callees", "node_type = 'Class'", "CALLS", "src_id", "dst_id")
_neighbours("importers", "importers", "node_type = 'Class'", "IMPORTS", "dst_id", "src_id")


@query(f"WITH {NODES} SELECT node_type, count(*)::BIGINT AS n FROM nodes GROUP BY 1")
def node_counts(spark, sf):
    return find.counts(testgraph.nodes(spark, sf), "node_type")


@query(f"WITH {EDGES} SELECT edge_type, count(*)::BIGINT AS n FROM edges GROUP BY 1")
def edge_counts(spark, sf):
    return find.counts(testgraph.edges(spark, sf), "edge_type")


@query(f"WITH {NODES} SELECT node_type, language, count(*)::BIGINT AS n FROM nodes GROUP BY ROLLUP (node_type, language)")
def node_rollup(spark, sf):
    return testgraph.nodes(spark, sf).rollup("node_type", "language").agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, {EDGES} SELECT language, count(*)::BIGINT AS n FROM nodes JOIN edges ON src_id = node_id WHERE edge_type = 'CALLS' GROUP BY 1")
def sql_passthrough(spark, sf):
    testgraph.nodes(spark, sf).createOrReplaceTempView("graph_nodes")
    testgraph.edges(spark, sf).createOrReplaceTempView("graph_edges")
    return spark.sql("SELECT language, count(*) AS n FROM graph_nodes JOIN graph_edges ON src_id = node_id WHERE edge_type = :kind GROUP BY language", args={"kind": "CALLS"})


@query(f"WITH {NODES}, {EDGES}, w AS (SELECT node_id FROM nodes WHERE language = 'json') SELECT edge_type, count(*)::BIGINT AS n FROM edges WHERE src_id IN (SELECT node_id FROM w) AND dst_id IN (SELECT node_id FROM w) GROUP BY 1")
def subgraph(spark, sf):
    nodes, edges = graph(spark, sf)
    return find.counts(find.subgraph(nodes, edges, nodes.filter("language = 'json'"))[1], "edge_type")


@query(f"WITH {EDGES} SELECT src_id, dst_id FROM edges WHERE edge_type = 'CALLS'")
def export_calls(spark, sf):
    return find.exported(testgraph.edges(spark, sf), "CALLS")


@query(f"WITH {NODES} SELECT node_id, file_path || ':' || start_line || '-' || end_line AS span, end_line - start_line + 1 AS lines FROM nodes WHERE file_path IS NOT NULL")
def source_spans(spark, sf):
    n = testgraph.nodes(spark, sf).filter("file_path is not null")
    return n.select("node_id", fn.span_text(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("span"), fn.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short, greatest(1, floor(length(text) / 3.5)::INT) AS tokens, substr(sha256(source || ':' || doc_id::VARCHAR), 1, 16) AS node FROM documents")
def sql_functions(spark, sf):
    from .functions import sql

    sql.register(spark)
    testgraph.views(spark, sf, "documents")
    return spark.sql("SELECT doc_id, shorten(text, 40) AS short, estimated_tokens(text) AS tokens, graph_node_id(source, CAST(doc_id AS STRING)) AS node FROM documents")


# Traversal, over all edges of the derived graph

_POPULAR = "(SELECT dst_id FROM edges GROUP BY dst_id ORDER BY count(*) DESC, dst_id LIMIT 1)"


def _popular(edges: DataFrame) -> DataFrame:
    """The node with most incoming edges; edges are written, so their number costs nothing."""
    top = counts_by(edges.select("dst_id", "src_id"), edges.count(), "dst_id").orderBy(F.desc("n"), "dst_id").limit(1)
    return top.select(F.col("dst_id").alias("seed"), F.col("dst_id").alias("node_id"))


def _reach_sql(depth: int, steps: str) -> str:
    """steps: the table of (near, far) steps."""
    return f"""WITH RECURSIVE {EDGES}, steps AS MATERIALIZED ({steps}), r(node_id, d) AS (SELECT {_POPULAR}, 0 UNION SELECT far, d + 1 FROM r JOIN steps ON near = node_id WHERE d < {depth})
SELECT node_id, min(d)::INT AS distance FROM r GROUP BY 1 HAVING min(d) > 0"""


_AGAINST = "SELECT DISTINCT dst_id AS near, src_id AS far FROM edges"
_BOTH = "SELECT src_id AS near, dst_id AS far FROM edges UNION SELECT dst_id, src_id FROM edges"


def _around_hub(spark, sf, depth, direction):
    edges = materialize(testgraph.edges(spark, sf))
    return traverse.reach(edges, _popular(edges), depth, direction, written=True).filter("distance > 0").select("node_id", "distance")


@query(_reach_sql(3, _AGAINST))
def dependents_d3(spark, sf):
    return _around_hub(spark, sf, 3, "in")


@query(_reach_sql(4, _AGAINST))
def impact_d4(spark, sf):
    return _around_hub(spark, sf, 4, "in")


@query(_reach_sql(2, _BOTH))
def neighbourhood_d2(spark, sf):
    return _around_hub(spark, sf, 2, "both")


@query(f"""WITH RECURSIVE {EDGES}, ends AS MATERIALIZED (SELECT min(src_id) AS a, max(dst_id) AS z FROM edges), steps AS MATERIALIZED ({_BOTH}),
r(node_id, d) AS (SELECT a, 0 FROM ends UNION SELECT far, d + 1 FROM r JOIN steps ON near = node_id WHERE d < 6),
lv AS MATERIALIZED (SELECT node_id, min(d) AS d FROM r GROUP BY 1),
p(path, tip, d) AS (SELECT [z], z, lv.d FROM ends JOIN lv ON node_id = z UNION ALL
 SELECT list_prepend(lv.node_id, path), lv.node_id, lv.d FROM p JOIN steps ON far = tip JOIN lv ON lv.node_id = near AND lv.d = p.d - 1)
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM p WHERE d = 0 ORDER BY p.path LIMIT 3""")
def shortest_path(spark, sf):
    edges = materialize(testgraph.edges(spark, sf, repeats=True))
    a, z = edges.agg(F.min("src_id"), F.max("dst_id")).first()
    return traverse.shortest_paths(edges, a, z, 6, written=True).select(F.array_join("path", ">").alias("path"), "hops")


def _pagerank_sql(k: int, links: str) -> str:
    """links: a query for distinct (repo, src, dst). Each repository is ranked by itself."""
    parts = [EDGES, f"links AS MATERIALIZED ({links})", "ids AS MATERIALIZED (SELECT repo, src AS id FROM links UNION SELECT repo, dst FROM links)", "deg AS MATERIALIZED (SELECT repo, src AS id, count(*) AS deg FROM links GROUP BY ALL)",
             "n AS MATERIALIZED (SELECT repo, count(*)::DOUBLE AS n FROM ids GROUP BY 1)", "k0 AS MATERIALIZED (SELECT repo, id, 1 / n AS rank FROM ids JOIN n USING (repo))"]
    for i in range(1, k + 1):
        b = f"k{i - 1}"
        loose = f"(SELECT repo, coalesce(sum(rank) FILTER (WHERE deg IS NULL), 0) AS loose FROM {b} LEFT JOIN deg USING (repo, id) GROUP BY 1)"
        got = f"(SELECT links.repo, dst AS id, sum(rank / deg) AS got FROM links JOIN {b} ON {b}.repo = links.repo AND {b}.id = src JOIN deg ON deg.repo = links.repo AND deg.id = src GROUP BY ALL)"
        parts.append(f"k{i} AS MATERIALIZED (SELECT repo, id, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS rank FROM ids JOIN n USING (repo) JOIN {loose} l USING (repo) LEFT JOIN {got} g USING (repo, id))")
    return f"WITH {', '.join(parts)} SELECT repo AS repo_id, id AS node_id, round(rank, 9) AS rank FROM k{k}"


_LINKS = "SELECT DISTINCT '' AS repo, src_id AS src, dst_id AS dst FROM edges WHERE edge_type IN ('CALLS', 'IMPORTS')"


@query(_pagerank_sql(10, _LINKS))
def pagerank_k10(spark, sf):
    links = testgraph.links(spark, sf, "CALLS", "IMPORTS")
    ranks = pagerank.pagerank(links, max_iterations=10, tolerance=None, rows=testgraph.most_edges(spark, sf, "CALLS") + testgraph.most_edges(spark, sf, "IMPORTS"), near=testgraph.near(links))
    return testgraph.node_name(ranks, "node_id").withColumn("rank", F.round("rank", 9))


# Two repositories in one store, with equal ids and paths: A has the graph, B its nodes and the edges whose target's id sorts first

_TWO_EDGES = "two AS MATERIALIZED (SELECT 'A' AS repo_id, * FROM edges UNION ALL SELECT 'B', * FROM edges WHERE dst_id < src_id)"


def _two(spark, sf):
    nodes, edges = graph(spark, sf)
    both = nodes.withColumn("repo_id", F.explode(F.array(F.lit("A"), F.lit("B"))))
    # Each edge is derived once, for both.
    return both, edges.withColumn("repo_id", F.explode(F.when(F.col("dst_id") < F.col("src_id"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))))


@query(f"WITH {NODES}, {EDGES}, {_TWO_EDGES} SELECT DISTINCT e.repo_id, e.src_id AS anchor, n.node_id FROM two e JOIN nodes n ON n.node_id = e.dst_id WHERE edge_type = 'CALLS' AND src_id <> dst_id")
def callees_two_repositories(spark, sf):
    nodes, edges = _two(spark, sf)
    return find.callees(nodes, edges, nodes, 2 * testgraph.most_edges(spark, sf, "CALLS")).select("repo_id", "anchor", "node_id")


@query(f"""WITH RECURSIVE {EDGES}, {_TWO_EDGES}, r(repo_id, node_id, d) AS (SELECT DISTINCT repo_id, {_POPULAR}, 0 FROM two UNION SELECT t.repo_id, src_id, d + 1 FROM r JOIN two t ON t.repo_id = r.repo_id AND dst_id = node_id WHERE d < 3)
SELECT repo_id, node_id, min(d)::INT AS distance FROM r GROUP BY ALL HAVING min(d) > 0""")
def dependents_two_repositories(spark, sf):
    _, edges = _two(spark, sf)
    edges = materialize(edges)
    starts = _popular(edges.filter("repo_id = 'A'")).withColumn("repo_id", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return traverse.reach(edges, starts, 3, written=True).filter("distance > 0").select("repo_id", "node_id", "distance")


@query(_pagerank_sql(5, "SELECT DISTINCT 'A' AS repo, src_id AS src, dst_id AS dst FROM edges UNION ALL SELECT DISTINCT 'B', src_id, dst_id FROM edges WHERE dst_id < src_id"))
def pagerank_two_repositories(spark, sf):
    links = testgraph.links(spark, sf)
    two = links.withColumn("repo_id", F.explode(F.when(testgraph.sorts_first(links, "dst_id", "src_id"), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))))
    ranks = pagerank.pagerank(two, max_iterations=5, tolerance=None, local_links=0, rows=testgraph.most_edges(spark, sf), near=testgraph.near(links))
    return testgraph.node_name(ranks, "node_id").withColumn("rank", F.round("rank", 9))


@query(f"""WITH {NODES}, {EDGES}, {_TWO_EDGES}, gone AS (SELECT node_id FROM nodes WHERE file_path LIKE 'orders/p1%')
SELECT 'A' AS repo_id, 'node' AS kind, count(*)::BIGINT AS n FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL SELECT 'B', 'node', count(*) FROM nodes
UNION ALL SELECT repo_id, edge_type, count(*) FROM two WHERE repo_id = 'B' OR (src_id NOT IN (SELECT node_id FROM gone) AND dst_id NOT IN (SELECT node_id FROM gone)) GROUP BY ALL""")
def delete_two_repositories(spark, sf):
    nodes, edges = _two(spark, sf)
    paths = nodes.filter("repo_id = 'A' and file_path like 'orders/p1%'").select("repo_id", "file_path").distinct()
    kept, left = store.delete_files(nodes, edges, paths)
    return kept.groupBy("repo_id", F.lit("node").alias("kind")).agg(F.count("*").alias("n")).unionByName(left.groupBy("repo_id", F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


@query(f"WITH {NODES} SELECT node_id, round(centrality_score * (1 + start_line / 400.0), 6) AS importance FROM nodes")
def importance(spark, sf):
    return testgraph.nodes(spark, sf).select("node_id", r6(fn.importance(F.col("centrality_score"), F.col("start_line") / 400.0)).alias("importance"))


# Resolution and storage

_RAW = """SELECT 'CALLS' AS edge_type, 'c' || CAST(o_custkey AS STRING) AS src_id,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'o' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'orders.o' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'FRANCE' WHEN 3 THEN 'missing' ELSE 's1' END AS dst_ref, o_orderkey FROM orders
UNION ALL SELECT 'IMPORTS', 'n' || CAST(n_nationkey AS STRING), 'mod.m' || CAST(n_nationkey % 7 AS STRING), -n_nationkey FROM nation"""
_MODS = "SELECT 'm' || CAST(n_nationkey AS STRING) AS node_id, 'File' AS node_type, 'file' AS name, 'f' || CAST(n_nationkey AS STRING) AS fqn, 'mod/m' || CAST(n_nationkey AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN '.py' ELSE '.ts' END AS file_path, n_nationkey AS ord FROM nation WHERE n_nationkey < 5"


@query(f"""WITH {NODES}, all_nodes AS (SELECT node_id, name, fqn, file_path FROM nodes WHERE node_type <> 'ConfigFile' UNION ALL SELECT node_id, name, fqn, file_path FROM ({_MODS})), raw AS ({_RAW}),
uniq AS (SELECT name, min(node_id) AS node_id FROM all_nodes GROUP BY name HAVING count(*) = 1)
SELECT edge_type, src_id, o_orderkey AS ref, coalesce(i.node_id, f.node_id, p.node_id, t.node_id, CASE WHEN edge_type <> 'IMPORTS' THEN u.node_id END) AS dst_id,
 CASE WHEN coalesce(i.node_id, f.node_id, p.node_id, t.node_id) IS NULL THEN 0.7 ELSE 0.9 END AS confidence
FROM raw JOIN all_nodes s ON s.node_id = src_id LEFT JOIN all_nodes i ON i.node_id = dst_ref LEFT JOIN (SELECT fqn, max(node_id) AS node_id FROM all_nodes GROUP BY 1) f ON f.fqn = dst_ref
LEFT JOIN (SELECT file_path, max(node_id) AS node_id FROM all_nodes GROUP BY 1) p ON edge_type = 'IMPORTS' AND p.file_path = replace(dst_ref, '.', '/') || '.py'
LEFT JOIN (SELECT file_path, max(node_id) AS node_id FROM all_nodes GROUP BY 1) t ON edge_type = 'IMPORTS' AND t.file_path = replace(dst_ref, '.', '/') || '.ts'
LEFT JOIN uniq u ON u.name = dst_ref
WHERE coalesce(i.node_id, f.node_id, p.node_id, t.node_id, CASE WHEN edge_type <> 'IMPORTS' THEN u.node_id END) IS NOT NULL""")
def name_resolution_cascade(spark, sf):
    testgraph.views(spark, sf, "nation", "orders")
    own = testgraph.nodes(spark, sf).filter("node_type <> 'ConfigFile'").select("node_id", "node_type", "name", "fqn", "file_path")
    nodes = own.unionByName(spark.sql(_MODS).select("node_id", "node_type", "name", "fqn", "file_path")).withColumns({"repo_id": F.lit(""), "file_ord": F.col("node_id"), "node_ord": F.lit(0)})
    raw = spark.sql(_RAW).withColumns({"repo_id": F.lit(""), "file_path": F.lit("x.py"), "confidence": F.lit(0.9), "edge_ord": F.col("o_orderkey"), "edge_id": F.concat_ws(":", "edge_type", "src_id", F.col("o_orderkey").cast("string"))})
    return resolve.resolve_edges(raw, nodes).select("edge_type", "src_id", F.col("o_orderkey").alias("ref"), "dst_id", F.col("confidence"))


@query(f"WITH {NODES}, {EDGES}, pairs(edge_type, s, d) AS (VALUES " + ", ".join(f"('{e}', '{s}', '{d}')" for e, s, d in resolve.ALLOWED_PAIRS) + ") SELECT e.edge_type, e.src_id, e.dst_id FROM edges e JOIN nodes a ON a.node_id = e.src_id JOIN nodes b ON b.node_id = e.dst_id JOIN pairs p ON p.edge_type = e.edge_type AND p.s = a.node_type AND p.d = b.node_type")
def edge_pair_validity(spark, sf):
    nodes = testgraph.nodes(spark, sf).withColumn("repo_id", F.lit(""))
    return resolve.valid_pairs(testgraph.edges(spark, sf).withColumn("repo_id", F.lit("")), nodes).select("edge_type", "src_id", "dst_id")


@query("SELECT text AS node_id, min(doc_id) AS kept FROM documents GROUP BY 1")
def node_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("").alias("repo_id"), F.col("text").alias("node_id"), F.lit("").alias("file_ord"), F.col("doc_id").alias("node_ord"))
    return resolve.dedupe_nodes(docs).select("node_id", F.col("node_ord").alias("kept"))


@query("SELECT l_partkey AS edge, min(l_orderkey * 10 + l_linenumber) AS kept FROM lineitem GROUP BY 1")
def edge_dedupe(spark, sf):
    li = table(spark, sf, "lineitem").select(F.lit("").alias("repo_id"), F.col("l_partkey").alias("edge_id"), F.lit("").alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_ord"))
    return resolve.dedupe_edges(li).select(F.col("edge_id").alias("edge"), F.col("edge_ord").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS v, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS origin FROM orders")
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders")
    old = o.select("o_orderkey", F.lit(0.0).alias("v"), F.lit("old").alias("origin"))
    return store.upsert(old, o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("v"), F.lit("new").alias("origin")), ["o_orderkey"])


@query(f"""WITH {NODES}, {EDGES}, gone AS (SELECT node_id FROM nodes WHERE file_path LIKE 'orders/p1%')
SELECT 'node' AS kind, node_id AS a, '' AS b FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT edge_type, src_id, dst_id FROM edges WHERE src_id NOT IN (SELECT node_id FROM gone) AND dst_id NOT IN (SELECT node_id FROM gone)""")
def delete_by_file(spark, sf):
    nodes, edges = graph(spark, sf)
    paths = nodes.filter("file_path like 'orders/p1%'").select("repo_id", "file_path").distinct()
    kept, edges = store.delete_files(nodes, edges, paths)
    return kept.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit("").alias("b")).unionByName(edges.select(F.col("edge_type").alias("kind"), F.col("src_id").alias("a"), F.col("dst_id").alias("b")))


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE source <> 'src2')
SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS rel_path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text""")
def change_set(spark, sf):
    docs = table(spark, sf, "documents")
    path, sha = F.col("doc_id").cast("string").alias("rel_path"), lambda c: F.sha2(c.cast("binary"), 256).alias("content_hash")
    # Between the two states one source came, another went, and texts of one language changed.
    indexed = docs.filter("source <> 'src1'").select(path, sha(F.col("text")))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return store.change_set(indexed, docs.filter("source <> 'src2'").select(path, sha(changed)))


# Vectors, ranking and packing

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def vector_topk(spark, sf):
    return _nearest(spark, sf, {})


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def vector_topk_filtered(spark, sf):
    return _nearest(spark, sf, {"label": 3})


@query(f"""WITH scored AS (SELECT q.vec_id AS probe_id, e.vec_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) SELECT probe_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 20""")
def vector_topk_many(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    probes = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "probe_id")
    return vectors.search_many(e, probes, 20, id_col="vec_id").select("probe_id", "rank", "vec_id", r6("score").alias("score"))


def _nearest(spark, sf, where):
    e = table(spark, sf, "embeddings")
    probe = e.filter("vec_id = 0").first().embedding
    return vectors.search(e, probe, 20, where, "vec_id").select("vec_id", r6("score").alias("score"))


@query(f"""WITH v AS (SELECT e.vec_id::VARCHAR AS node_id, {_COS} AS s, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r <= 30),
g AS (SELECT vec_id::VARCHAR AS node_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings QUALIFY r <= 30)
SELECT node_id, round(coalesce(1.0 / (60 + g.r), 0) + coalesce(1.0 / (60 + v.r), 0), 9) AS rrf, round(greatest(coalesce(v.s, 0), 0), 6) AS semantic_score
FROM g FULL JOIN v USING (node_id) ORDER BY coalesce(1.0 / (60 + g.r), 0) + coalesce(1.0 / (60 + v.r), 0) DESC, g.r IS NULL, g.r, v.r LIMIT 20""")
def rrf_hybrid(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "embeddings")
    near = vectors.search(e, e.filter("vec_id = 0").first().embedding, 30, None, "vec_id")
    number = lambda df, *order: df.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("node_id", F.col("vec_id").cast("string"))  # noqa: E731  thirty rows
    graph = number(e.orderBy(F.desc("label"), "vec_id").limit(30), F.desc("label"), "vec_id").withColumn("semantic_score", F.lit(0.0))
    fused = ranking.fuse(graph, number(near, F.desc("score"), "vec_id").withColumn("semantic_score", F.col("score")))
    return fused.select("node_id", F.round("rrf", 9).alias("rrf"), r6("semantic_score").alias("semantic_score"))


@query(f"""WITH {NODES}, x AS (SELECT *, (start_line % 10) / 10.0 AS sem FROM nodes),
s AS (SELECT node_id, node_type, 0.35 * sem + 0.25 * centrality_score / coalesce(nullif(max(centrality_score) OVER w, 0), 1) + 0.2 * ((contains(lower(fqn || ' ' || name), 'o1'))::INT + (contains(lower(fqn || ' ' || name), 'europe'))::INT) / 2.0 + 0.1 * importance_score / coalesce(nullif(max(importance_score) OVER w, 0), 1) AS score FROM x WINDOW w AS (PARTITION BY node_type))
SELECT node_id, round(score, 6) AS score FROM s""")
def rank_weighted(spark, sf):
    nodes = testgraph.nodes(spark, sf).withColumns({"semantic_score": (F.col("start_line") % 10) / 10.0, "input_rank": F.col("node_id")})
    return ranking.rank(nodes, F.array(F.lit("O1"), F.lit("europe")), partition=("node_type",)).select("node_id", r6("score").alias("score"))


@query(f"WITH {NODES} SELECT node_id, round(((contains(lower(fqn || ' ' || name), 'asia'))::INT + (contains(lower(fqn || ' ' || name), '#00'))::INT + (contains(lower(fqn || ' ' || name), 'steel'))::INT) / 3.0, 6) AS hit FROM nodes")
def name_match(spark, sf):
    terms = F.array(F.lit("asia"), F.lit("#00"), F.lit("Steel"))
    return testgraph.nodes(spark, sf).select("node_id", r6(fn.name_match(terms, F.col("fqn"), F.col("name"))).alias("hit"))


@query("""WITH b AS (SELECT lang, doc_id, text AS block FROM documents), u AS (SELECT *, sum(length(block) + 7) OVER (PARTITION BY lang ORDER BY doc_id) AS used FROM b),
v AS (SELECT *, used - length(block) - 7 AS before, 21000 - 16 AS budget FROM u)
SELECT lang, doc_id, CASE WHEN used <= budget THEN block ELSE substr(block, 1, (budget - before - 7)::INT) || chr(10) || '… [truncated]' END AS block FROM v WHERE used <= budget OR (before <= budget AND budget - before - 7 > 200)""")
def context_pack(spark, sf):
    blocks = table(spark, sf, "documents").select("lang", "doc_id", F.col("text").alias("block"))
    return packing.pack_prefix(blocks, 6000, "", "doc_id", ("lang",)).select("lang", "doc_id", "block")


@query("""WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY length(text) % 97 DESC, doc_id) AS n FROM documents),
f(n, used, k, hit, doc_id) AS (SELECT 0::BIGINT, 0::BIGINT, 0, FALSE, -1::BIGINT UNION ALL
 SELECT c.n, CASE WHEN ok THEN f.used + c.chars ELSE f.used END, CASE WHEN ok THEN k + 1 ELSE k END, ok, c.doc_id
 FROM f JOIN c ON c.n = f.n + 1, LATERAL (SELECT greatest(1, floor((16 + f.used + c.chars + 7 * k) / 3.5)) <= 9000 AS ok))
SELECT doc_id FROM f WHERE hit""")
def greedy_trim(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("chars")).withColumn("ord", -(F.col("chars") % 97))
    return packing.greedy_fit_all(d, 9000, "claude").select(F.col("id").alias("doc_id"))


# Review context

_HUNKS = "SELECT c_custkey AS ord, c_custkey AS hunk_id, r_name || '/' || n_name AS file_path, CAST(c_custkey % 490 + 1 AS INT) AS start_line, CAST(c_custkey % 490 + 1 + c_custkey % 9 AS INT) AS end_line, FALSE AS is_new, FALSE AS is_deleted FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_RANK = "CASE node_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(review.SYMBOL_TYPES)) + " END"


@query(f"WITH {NODES}, h AS ({_HUNKS}), m AS (SELECT hunk_id, node_id, row_number() OVER (PARTITION BY hunk_id ORDER BY {_RANK}, n.end_line - n.start_line, n.start_line, node_id) AS k FROM h JOIN nodes n ON n.file_path = h.file_path AND n.start_line <= h.end_line AND n.end_line >= h.start_line AND {_RANK} IS NOT NULL) SELECT hunk_id, node_id FROM m WHERE k = 1")
def hunk_overlap_narrowest(spark, sf):
    nodes = testgraph.nodes(spark, sf)
    return review.narrowest(spark.sql(_HUNKS), nodes).select("hunk_id", "node_id")


@query(f"WITH {NODES}, {EDGES}, c AS (SELECT src_id AS node_id, 'caller' AS reason, 1 AS distance FROM edges WHERE edge_type = 'CALLS' UNION ALL SELECT dst_id, 'test', 2 FROM edges WHERE edge_type = 'IMPLEMENTS') SELECT node_id, reason, round((CASE reason WHEN 'test' THEN 0.65 ELSE 0.55 END) + 0.2 / (1 + distance) + 0.2 * importance_score, 6) AS score, count(*)::BIGINT AS n FROM c JOIN nodes USING (node_id) GROUP BY ALL")
def candidate_score(spark, sf):
    e = testgraph.edges(spark, sf)
    c = e.filter("edge_type = 'CALLS'").selectExpr("src_id as node_id", "'caller' as reason", "1 as distance").unionByName(e.filter("edge_type = 'IMPLEMENTS'").selectExpr("dst_id as node_id", "'test' as reason", "2 as distance"))
    scored = c.join(testgraph.nodes(spark, sf), "node_id").select("node_id", "reason", r6(review.score(F.col("reason"), F.col("distance"), F.col("importance_score"))).alias("score"))
    return scored.groupBy("node_id", "reason", "score").agg(F.count("*").alias("n"))


_CANDS = "SELECT 's' || CAST(l_suppkey AS STRING) AS seed, 'o' || CAST(l_orderkey AS STRING) AS node_id, CASE WHEN l_linenumber % 3 = 0 THEN 'callee' WHEN l_linenumber % 3 = 1 THEN 'caller' ELSE 'impacted' END AS reason, CASE WHEN l_linenumber % 3 = 2 THEN 2 ELSE 1 END AS distance, l_partkey AS ord FROM lineitem"
_PRIO = "CASE reason WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 ELSE 4 END"


@query(f"WITH c AS ({_CANDS}), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_PRIO}, distance, ord, node_id) AS n FROM c) SELECT node_id, arg_min(reason, {_PRIO}) AS reason, arg_min(distance, {_PRIO}) AS distance FROM k WHERE n <= 8 GROUP BY 1")
def neighbor_cap_merge(spark, sf):
    testgraph.views(spark, sf, "lineitem")
    return review.cap_and_merge(spark.sql(_CANDS)).drop("repo_id")


@query(f"""WITH {NODES}, s AS (SELECT node_id AS seed, unnest(tags[1:3]) AS tag FROM nodes WHERE node_type = 'Class'),
c AS (SELECT node_id, tag, row_number() OVER (PARTITION BY tag ORDER BY node_id) AS k FROM (SELECT node_id, unnest(tags) AS tag FROM nodes WHERE node_type = 'ConfigFile'))
SELECT DISTINCT seed, c.node_id FROM s JOIN c ON c.tag = s.tag AND k <= 2""")
def related_config_by_tag(spark, sf):
    nodes, _ = graph(spark, sf)
    return review.related_configs(nodes.filter("node_type = 'Class'"), nodes).select("seed", "node_id")


@query("SELECT source, sum(greatest(1, floor(length(text) / 3.5)::INT))::BIGINT AS baseline FROM documents WHERE length(text) > 0 GROUP BY 1")
def baseline_tokens(spark, sf):
    d = table(spark, sf, "documents").filter(F.length("text") > 0)
    return d.groupBy("source").agg(F.sum(fn.estimate_tokens(F.length("text"), "claude").cast("bigint")).alias("baseline"))


# Without SQL counterparts: checked by tests


@query()
def dsl_end_to_end(spark, sf):
    nodes, edges = testgraph.nodes(spark, sf), testgraph.edges(spark, sf)
    found = dsl.execute("FIND class WHERE fqn ~ EUROPE LIMIT 40", nodes, edges).withColumn("semantic_score", F.lit(0.0))
    ranked = ranking.rank(found, F.array(F.lit("france"), F.lit("class")))
    none = F.array().cast("array<struct<edge_type:string,dst_name:string>>")
    blocks = ranked.select("position", fn.node_block(F.col("node_type"), F.col("fqn"), F.lit(""), F.col("docstring"), F.col("file_path"), F.col("start_line"), F.col("end_line"), none).alias("block"))
    return packing.pack_prefix(blocks, 800)


@query()
def review_bundle(spark, sf):
    # Hops are made distinct where they are few, so edges may be repeated.
    nodes, edges = materialize(graph(spark, sf)[0]), materialize(testgraph.edges(spark, sf, repeats=True))
    hunks = spark.sql(_HUNKS)
    seeds = materialize(review.seeds(hunks, nodes).join(nodes.select(*traverse.ID, "tags"), traverse.ID))
    near = review.expand(seeds, nodes, edges).unionByName(seeds.select(*traverse.ID, F.lit("touched").alias("reason"), F.lit(0).alias("distance")))
    full = near.join(nodes, traverse.ID)
    block = fn.node_block(F.col("node_type"), F.col("fqn"), F.lit(""), F.col("docstring"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.array().cast("array<struct<edge_type:string,dst_name:string>>"))
    scored = full.select("file_path", *traverse.ID, "reason", "distance", review.score(F.col("reason"), F.col("distance"), F.col("importance_score")).alias("score"), F.length(block).alias("chars"))
    return review.trim(scored, 4000, "claude", ("file_path",)).select("node_id", "reason", "distance", r6("score").alias("score"))

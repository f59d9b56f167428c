"""Two repositories with equal paths and names in one store: each fares as if it had the store to itself."""

import pytest
from meshwright.config import Config
from meshwright.engine import QueryEngine
from meshwright.index import Indexer
from meshwright.operators import find, pagerank, review, traverse
from meshwright.operators.store import GraphStore
from pyspark.sql import functions as F

from .samples import PYTHON, write

#: The second has the same files and names, with other calls among them.
OTHER = {k: v.replace("_issue_receipt(", "_open_account(") for k, v in PYTHON.items()} | {"extra.py": "from billing import charge\n\ndef more():\n    charge(1, 2)\n"}
DIFF = "diff --git a/billing.py b/billing.py\n--- a/billing.py\n+++ b/billing.py\n@@ -9,2 +9,2 @@\n"


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """(shared, {repo_id: own store}, {repo_id: folder})."""
    top = tmp_path_factory.mktemp("two")
    shared, own, roots = GraphStore(spark, str(top / "shared")), {}, {}
    for repo, files in (("A", PYTHON), ("B", OTHER)):
        roots[repo] = top / repo
        write(roots[repo], files)
        config = Config(repo_path=str(roots[repo]), repo_id=repo, db_path=str(top / f"only-{repo}"), enable_git_enrichment=False)
        own[repo] = GraphStore(spark, config.db_path)
        Indexer(spark, config, own[repo]).run()
        Indexer(spark, config, shared).run()
    return shared, own, roots


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_tables_and_ranks(stores):
    shared, own, _ = stores
    score = F.round("importance_score", 9)
    for repo, store in own.items():
        mine = F.col("repo_id") == repo
        assert rows(shared.nodes.filter(mine), "node_id", "fqn", score) == rows(store.nodes, "node_id", "fqn", score)
        assert rows(shared.edges.filter(mine), "edge_id", "src_id", "dst_id") == rows(store.edges, "edge_id", "src_id", "dst_id")
    both = pagerank.pagerank(shared.edges, tolerance=1e-9)
    for repo, store in own.items():
        alone = pagerank.pagerank(store.edges, tolerance=1e-9)
        assert rows(both.filter(F.col("repo_id") == repo), "node_id", F.round("rank", 9)) == rows(alone, "node_id", F.round("rank", 9))


def test_traversal_and_lookups(stores):
    shared, own, _ = stores
    for repo, store in own.items():
        for target in ("billing.charge", "models.Account"):
            want = rows(traverse.dependents(store.nodes, store.edges, target, 4, None, repo), "repo_id", "node_id", "distance")
            assert rows(traverse.dependents(shared.nodes, shared.edges, target, 4, None, repo), "repo_id", "node_id", "distance") == want and want
            assert rows(traverse.neighbourhood(shared.nodes, shared.edges, target, 2, None, repo), "repo_id", "node_id", "distance") == rows(traverse.neighbourhood(store.nodes, store.edges, target, 2, None, repo), "repo_id", "node_id", "distance")
        for near in (find.callers, find.callees, find.importers, find.tests_of):
            got = near(shared.nodes, shared.edges, shared.nodes.filter(F.col("repo_id") == repo))
            assert rows(got, "repo_id", "anchor", "node_id") == rows(near(store.nodes, store.edges, store.nodes), "repo_id", "anchor", "node_id")
        some = shared.nodes.filter((F.col("repo_id") == repo) & (F.col("file_path") == "billing.py"))
        inner = find.subgraph(shared.nodes, shared.edges, some)[1]
        assert rows(inner, "edge_id") == rows(find.subgraph(store.nodes, store.edges, store.nodes.filter("file_path = 'billing.py'"))[1], "edge_id")


def test_engine(spark, stores):
    shared, own, roots = stores
    for repo, store in own.items():
        config = Config(repo_path=str(roots[repo]), repo_id=repo)
        a, b = QueryEngine(spark, config, shared), QueryEngine(spark, config, store)
        for ask in (
            lambda e: e.query_dsl('IMPACT "billing.charge" DEPTH 4'), lambda e: e.query_hybrid("charge an account"), lambda e: e.query_semantic("charge an account"),
            lambda e: e.query_path("routes.buy", "billing._open_account"), lambda e: e.query_nl("What calls the accepts_amount function?"), lambda e: e.neighbourhood("billing.charge", 2), lambda e: e.query_impact("models.Account"),
        ):
            x, y = ask(a), ask(b)
            assert x.as_dict() == y.as_dict() and x.context == y.context and x.rows
            assert {r["repo_id"] for r in x.rows} == {repo}
        assert a.review(DIFF).to_dict() == b.review(DIFF).to_dict()


def test_delete(spark, stores, tmp_path):
    shared, _, _ = stores
    copy = GraphStore(spark, str(tmp_path / "copy"))
    for table in ("nodes", "edges", "embeddings"):
        copy.replace(table, shared.table(table))
    copy.delete_files(spark.createDataFrame([("A", "billing.py")], "repo_id string, file_path string"))
    for table in ("nodes", "edges", "embeddings"):
        kept, was = copy.table(table), shared.table(table)
        assert kept.filter("repo_id = 'B'").count() == was.filter("repo_id = 'B'").count()
        assert kept.filter("repo_id = 'A'").count() < was.filter("repo_id = 'A'").count()
    assert copy.nodes.filter("repo_id = 'A' and file_path = 'billing.py'").isEmpty()


def test_best_upstream_equals_reach(spark):
    import random

    rng = random.Random(2)
    e = spark.createDataFrame([("r", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(120)], "repo_id string, src_id string, dst_id string")
    n = spark.createDataFrame([("r", f"n{i}", rng.random()) for i in range(40)], "repo_id string, node_id string, importance_score double")
    seeds = n.filter("importance_score > 0.5").select("repo_id", "node_id")
    score = {r.node_id: r.importance_score for r in n.collect()}
    for depth in (2, 3):
        want = {}
        for r in traverse.reach(e, seeds.select("repo_id", F.col("node_id").alias("seed"), "node_id"), depth, "in").filter("distance > 0").collect():
            want.setdefault(r.seed, []).append(r.node_id)
        want = {(s, x, k) for s, found in want.items() for k, x in enumerate(sorted(found, key=lambda x: (-score[x], x))[:4], 1)}
        assert {(r.seed, r.node_id, r.k) for r in review.best_upstream(seeds, n, e, depth, 4).collect()} == want


def test_anchors_filter_edges_before_they_are_made_distinct(spark):
    e = spark.createDataFrame([("a", "b", "CALLS")], "src_id string, dst_id string, edge_type string")
    n = spark.createDataFrame([("a", "x"), ("b", "y")], "node_id string, name string")
    plan = find.callers(n, e, n.filter("name = 'y'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_page_rank_rounds_shuffle_no_links(spark):
    """Links and ranks are written in buckets of one key, so their join has no exchange below it."""
    from meshwright.tables import materialize_by

    links = materialize_by(spark.createDataFrame([("", "a", "b")], "repo_id string, src_id string, dst_id string"), "repo_id", "src_id")
    given = materialize_by(spark.createDataFrame([("", "a", 1.0)], "repo_id string, node_id string, share double"), "repo_id", "node_id").withColumnRenamed("node_id", "src_id")
    plan = links.join(given.hint("merge"), ["repo_id", "src_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan

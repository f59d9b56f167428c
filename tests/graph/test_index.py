"""Indexing real folders: golden graph, incremental equal to full, queries, review, workspace, HTTP and command line."""

import json
import subprocess
import threading
import urllib.error
import urllib.request

import pytest
from meshwright import cli, questions, serve
from meshwright.config import Config, Workspace, find_config, load_config
from meshwright.engine import QueryEngine
from meshwright.index import Indexer, index_workspace
from meshwright.operators.store import GraphStore
from meshwright.sources import diffs, gitlog, repository
from pyspark.sql import functions as F

from .samples import CONFIG, PYTHON, TYPESCRIPT, write


def indexer(spark, root, db, **more):
    return Indexer(spark, Config(repo_path=str(root), db_path=str(db), enable_git_enrichment=False, **more))


def edges(store):
    n = store.nodes.select("node_id", "fqn")
    e = store.edges.join(n.withColumnRenamed("node_id", "src_id").withColumnRenamed("fqn", "s"), "src_id").join(n.withColumnRenamed("node_id", "dst_id").withColumnRenamed("fqn", "d"), "dst_id")
    return {(r.edge_type, r.s, r.d) for r in e.select("edge_type", "s", "d").collect()}


def snapshot(store):
    nodes = {r.node_id: tuple(r) for r in store.nodes.select("node_id", "node_type", "fqn", "file_path", "start_line", "tags", F.round("importance_score", 9)).collect()}
    vectors = {r.node_id: r.document for r in store.table("embeddings").collect()}
    return nodes, {tuple(r) for r in store.edges.select("edge_id", "edge_type", "src_id", "dst_id", "confidence").collect()}, vectors


@pytest.fixture(scope="module")
def python_repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("py")
    write(root, PYTHON | CONFIG | {"README.md": "# no parser", "_private/__init__.py": "x = 1\n", "node_modules/a.js": "function no() {}"})
    ix = indexer(spark, root, root / ".meshwright/graph")
    report = ix.run()
    assert report.errors == []
    return root, ix


def test_golden_graph(python_repo):
    _, ix = python_repo
    got = edges(ix.store)
    assert {e for e in got if e[0] == "CALLS"} == {
        ("CALLS", "routes.buy", "billing.charge"), ("CALLS", "routes.undo_purchase", "billing.refund"), ("CALLS", "billing.charge", "billing._open_account"), ("CALLS", "billing.charge", "billing._issue_receipt"),
    }
    assert {e[1:] for e in got if e[0] == "IMPORTS"} == {("routes.py", "billing.py"), ("billing.py", "models.py"), ("test_billing.py", "billing.py")}
    assert {e[1:] for e in got if e[0] == "EXPOSES_ENDPOINT"} == {("routes.buy", "routes.buy:endpoint"), ("routes.undo_purchase", "routes.undo_purchase:endpoint"), ("routes.ping", "routes.ping:endpoint")}
    assert {e[1] for e in got if e[0] == "INHERITS"} == {"models.Account", "models.Receipt"}
    files = {r.file_path for r in ix.store.nodes.filter("node_type = 'File'").collect()}
    assert "_private/__init__.py" in files and not any("node_modules" in f or f.endswith(".md") for f in files)


def test_typescript_imports_and_implements(spark, tmp_path):
    write(tmp_path / "r", TYPESCRIPT | {"lib/impl.ts": "import { Account } from '../types';\nexport class Impl implements Account {}\n", "lib/index.ts": "export * from './impl';\n", "main.ts": "import { Impl } from './lib';\n"})
    ix = indexer(spark, tmp_path / "r", tmp_path / "db")
    ix.run(embed=False)
    got = edges(ix.store)
    assert {e[1:] for e in got if e[0] == "IMPORTS"} == {("billing.ts", "types.ts"), ("lib/impl.ts", "types.ts"), ("lib/index.ts", "lib/impl.ts"), ("main.ts", "lib/index.ts")}
    assert {e[1:] for e in got if e[0] == "IMPLEMENTS"} == {("lib.impl.Impl", "types.Account")}


def test_tested_by(spark, tmp_path):
    write(tmp_path / "r", {k: PYTHON[k] for k in ("billing.py", "test_billing.py")})
    ix = indexer(spark, tmp_path / "r", tmp_path / "db")
    ix.run(embed=False)
    assert {e for e in edges(ix.store) if e[0] == "TESTED_BY"} == {("TESTED_BY", "billing.charge", f"test_billing.{t}") for t in ("test_ok", "test_bad", "test_many")}


def test_queries(spark, python_repo):
    root, ix = python_repo
    engine = QueryEngine(spark, ix.config, ix.store)
    found = engine.query_dsl('DEPENDENTS "billing._issue_receipt"')
    assert {"billing.charge", "routes.buy"} <= {r["fqn"] for r in found.rows} and found.error is None
    path = engine.query_path("routes.buy", "billing._open_account")
    assert path.paths[0] == ["routes.buy", "billing.charge", "billing._open_account"]
    assert [r["fqn"] for r in engine.query_dsl('PATH FROM "routes.buy" TO "billing._open_account"').rows[:3]] == path.paths[0]
    assert {r["fqn"] for r in engine.query_dsl("FIND endpoint").rows} == {"routes.buy:endpoint", "routes.undo_purchase:endpoint", "routes.ping:endpoint"}
    assert engine.query_dsl("FIND function WHERE tag = payments AND name ~ ref LIMIT 5").rows[0]["node_type"] == "Function"
    assert engine.query_dsl("FIND * LIMIT many").error and engine.query_dsl("nonsense").rows == [] and engine.query_impact("buy", 11).error
    near = engine.query_semantic("accepts amount of an account", 5)
    assert near.rows[0]["semantic_score"] > 0 and len(near.rows) == 5 and near.context.startswith("# Code Context\n**Query:** accepts")
    assert engine.query_semantic("x", node_type="Test").rows and all(r["node_type"] == "Test" for r in engine.query_semantic("x", node_type="Test").rows)
    assert engine.query_hybrid("create receipt").rows and len(engine.pack_context(near, 60)) < len(near.context)
    nl = engine.query_nl("What calls the accepts_amount function?")
    assert nl.intent == "structural" and nl.rows
    assert engine.query_nl("retry logic").intent == "semantic"
    assert "related" not in near.as_dict()["nodes"][0] and "CALLS → `" in engine.query_dsl("FIND function WHERE name = buy").context
    assert engine.neighbourhood("billing.charge", 1).rows
    sql = ix.store.sql("SELECT count(*) AS n FROM nodes WHERE node_type = :t", t="Test").first()
    assert sql.n == 3 and ix.store.node_count("Test") == 3 and ix.store.edge_count("IMPORTS") == 3 and ix.store.schema_version() == 3


def test_questions(spark, python_repo):
    _, ix = python_repo
    nodes = ix.store.nodes
    assert questions.entities(nodes, ["charge", "accepts_amuont", "nothing_like_it"]) == ["billing.charge", "models.Account.accepts_amount"]
    assert questions.build(spark, nodes, "path from accepts_amount to undo_purchase")[1] == 'PATH FROM "models.Account.accepts_amount" TO "routes.undo_purchase"'
    assert questions.build(spark, nodes, "What breaks if I change undo_purchase?")[1] == 'IMPACT "routes.undo_purchase" DEPTH 3'
    assert questions.build(spark, nodes, "list all classes")[1] == "FIND * LIMIT 20"
    assert questions.build(spark, nodes, "x", lambda q: "FIND test")[1] == "FIND test"
    assert questions.build(spark, nodes, "callers of undo_purchase", lambda q: 1 / 0)[1].startswith("IMPACT")


DIFF = """diff --git a/billing.py b/billing.py
--- a/billing.py
+++ b/billing.py
@@ -9,2 +9,2 @@ def charge
@@ -30 +2,0 @@
diff --git a/models.py b/models.py
deleted file mode 100644
--- a/models.py
+++ /dev/null
@@ -1,3 +0,0 @@
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,4 @@
diff --git a/same.py b/same.py
"""


def test_diff():
    files = diffs.parse_diff(DIFF)
    assert [(f.path, f.is_new, f.is_deleted, f.ranges) for f in files] == [
        ("billing.py", False, False, [(9, 10, "modified"), (2, 2, "deleted")]), ("models.py", False, True, [(1, 1, "deleted")]), ("new.py", True, False, [(1, 4, "added")]),
    ]


def test_diff_lines_that_read_like_headers():
    text = "diff --git a/x.sql b/x.sql\n--- a/x.sql\n+++ b/x.sql\n@@ -1,3 +1,3 @@\n a\n--- old comment\n+++ b/new comment\n b\n\\ No newline at end of file\n@@ -9 +9,2 @@\n-c\n+d\n+e\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n"
    first = diffs.parse_diff(text.split("--- a/y")[0])
    assert [(f.path, f.ranges) for f in first] == [("x.sql", [(1, 3, "modified"), (9, 10, "modified")])]


def test_no_word_crowds_out_another(spark):
    rows = [("aaa", f"m{i}.aaa") for i in range(1500)] + [("zzz", "z.zzz"), ("zzz", "y.zzz"), ("other_name", "o.other_name")] + [(f"simila{i:03}", f"s{i}") for i in range(300)]
    nodes = spark.createDataFrame(rows, "name string, fqn string")
    assert questions.entities(nodes, ["aaa", "zzz"], 9) == ["m0.aaa", "m1.aaa", "y.zzz", "z.zzz"]
    assert questions.entities(nodes, ["simila001x", "other_nam"], 9)[-1] == "o.other_name"


def test_every_failed_file_is_counted(spark, tmp_path):
    write(tmp_path / "r", {f"m{i:03}.py": "def f(): pass\n" for i in range(130)})

    def broken(build, source):
        raise ValueError("no")

    ix = Indexer(spark, Config(repo_path=str(tmp_path / "r"), db_path=str(tmp_path / "db"), enable_git_enrichment=False), parsers={"python": broken})
    report = ix.run(embed=False)
    assert report.failed == 130 and len(report.errors) == 100


def test_languages_and_extensions(spark, tmp_path):
    write(tmp_path, {"a.py": "x", "b.ts": "1", "c.TS": "1", "d.json": "{}"})
    names = lambda **o: {r.rel_path for r in repository.scan(spark, tmp_path, **o).collect()}
    assert names(languages=["python"]) == {"a.py"} and names(extensions=[".ts", ".json"]) == {"b.ts", "c.TS", "d.json"} and names(extensions=[".ts"], languages=["json"]) == set()
    assert len(names(languages=[], extensions=[])) == 4


def test_review(spark, python_repo):
    _, ix = python_repo
    engine = QueryEngine(spark, ix.config, ix.store)
    bundle = engine.review(DIFF, number=7, title="t")
    assert {s["fqn"] for s in bundle.seeds} == {"billing.charge", "billing.py", "models.py"}
    reasons = {n["fqn"]: n["reason"] for n in bundle.nodes}
    assert reasons["routes.buy"] == "caller" and reasons["billing._open_account"] == "callee"
    assert bundle.context_text.startswith("# Code Context\n**Query:** PR #7 — t — 3 touched symbol(s)") and bundle.baseline_tokens > 0
    tight = engine.review(DIFF, token_budget=0)
    assert len(tight.nodes) == 3 and tight.dropped_count == len(bundle.nodes) - 3
    assert engine.review("diff --git a/x b/x\n+++ b/x\n@@ -1 +1 @@\n").notes
    json.dumps(bundle.to_dict())


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "r"
    write(root, PYTHON | CONFIG | TYPESCRIPT)
    ix = indexer(spark, root, tmp_path / "db")
    ix.run()
    before = snapshot(ix.store)
    assert ix.changes().isEmpty() and ix.update().files == 0 and snapshot(ix.store) == before
    (root / "billing.py").write_text((root / "billing.py").read_text().replace("def refund", "def give_back") + "\n\ndef extra():\n    buy(1, 2)\n")
    (root / "types.ts").unlink()
    write(root, {"pkg/more.py": "from billing import extra\n\ndef use():\n    extra()\n", "settings.toml": "[other]\n"})
    assert {(r.rel_path, r.change) for r in ix.changes().collect()} == {("billing.py", "modified"), ("types.ts", "deleted"), ("pkg/more.py", "added"), ("settings.toml", "modified")}
    ix.update()
    full = indexer(spark, root, tmp_path / "db2")
    full.run()
    assert snapshot(ix.store) == snapshot(full.store)
    assert ("CALLS", "pkg.more.use", "billing.extra") in edges(ix.store) and ("CALLS", "billing.extra", "routes.buy") in edges(ix.store)
    ix.run()
    assert snapshot(ix.store) == snapshot(full.store)


def test_workspace(spark, tmp_path):
    for name in ("one", "two"):
        write(tmp_path / name, {"a.py": f"def {name}(): pass\n\ndef shared(): {name}()\n"})
    ws = Workspace.init(tmp_path)
    assert ws.add(tmp_path / "one").id == "one"
    ws.add(tmp_path / "two", "second")
    with pytest.raises(ValueError):
        ws.add(tmp_path / "two", "one")
    ws.save()
    again = Workspace.load(tmp_path)
    assert [(r.id, r.path.name) for r in again.repos] == [("one", "one"), ("second", "two")] and again.db_path == ws.db_path
    index_workspace(spark, again)
    store = GraphStore(spark, str(again.db_path))
    assert {(r.repo_id, r.name) for r in store.nodes.filter("node_type = 'Function'").collect()} == {("one", "one"), ("one", "shared"), ("second", "two"), ("second", "shared")}
    assert store.edge_count("CALLS") == 2
    engine = QueryEngine(spark, Config(db_path=str(again.db_path)), store)
    assert {r["repo_id"] for r in engine.query_dsl("FIND function", "second").rows} == {"second"}
    for text, mode in (("FIND function", "auto"), ("shared", "semantic"), ("shared", "hybrid"), ("FIND function", "dsl")):
        assert cli.main(["workspace", "query", text, "--workspace", str(tmp_path), "--mode", mode, "--context"], spark) == 0
    again.remove("one")
    with pytest.raises(KeyError):
        again.get("one")
    with pytest.raises(FileNotFoundError):
        Workspace.load(tmp_path / "none")


def test_config(tmp_path):
    (tmp_path / "meshwright.toml").write_text('[meshwright]\ndefault_top_k = 7\nexclude_patterns = ["x*"]\nunknown = 1\n')
    deep = tmp_path / "a/b"
    deep.mkdir(parents=True)
    assert find_config(deep) == tmp_path / "meshwright.toml"
    with pytest.warns(UserWarning, match="unknown"):
        c = load_config(deep, repo_id="r", db_path=None)
    assert (c.default_top_k, c.exclude_patterns, c.repo_id, c.context_max_tokens) == (7, ("x*",), "r", 6000)


def test_scan_filters(spark, tmp_path):
    write(tmp_path, {"a.py": "x", "big.py": "y" * 5000, "s/b.min.js": "z", "s/c.ts": "1", "s/__init__.py": "", "dist/d.py": "1", ".hidden.py": "h", "e.txt": "t", "skip.py": "s", ".gitignore": "# c\nskip*\n"})
    got = {r.rel_path: r for r in repository.scan(spark, tmp_path, "rid", max_file_size_bytes=1000, files_per_partition=2).collect()}
    assert set(got) == {"a.py", "s/c.ts", "s/__init__.py", ".hidden.py"} and got["a.py"].repo_id == "rid" and got["s/__init__.py"].size_bytes == 0
    assert repository.scan(spark, tmp_path / "s", only=["c.ts"]).count() == 1 and repository.scan(spark, tmp_path / "s", only=["no.ts"]).count() == 0


def test_git_history(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    write(tmp_path, {"a.py": "def a(): b()\n", "b.py": "def b(): pass\n"})
    assert gitlog.commits(spark, tmp_path / "none") is None
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "1")
    (tmp_path / "a.py").write_text("def a(): b() or 1\n")
    git("commit", "-qam", "2")
    ix = Indexer(spark, Config(repo_path=str(tmp_path), db_path=str(tmp_path / ".meshwright/g")))
    ix.run(embed=False)
    got = {r.fqn: r for r in ix.store.nodes.collect()}
    assert (got["a.a"].change_frequency, got["b.b"].change_frequency) == (1.0, 0.5)
    assert len(got["a.a"].last_modified_commit) == 8 and got["a.a"].last_modified_commit != got["b.b"].last_modified_commit
    assert got["b.b"].importance_score == pytest.approx(got["b.b"].centrality_score * 1.5)


def test_http(spark, python_repo):
    _, ix = python_repo
    server = serve.make_server(QueryEngine(spark, ix.config, ix.store), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/health")[1]["status"] == "ok" and call("/v1/info")[1]["node_count"] == ix.store.node_count()
        status, data = call("/v1/query/dsl", {"query": "FIND test"})
        assert status == 200 and data["node_count"] == 3 and data["context"]
        assert "context" not in call("/v1/query/impact", {"target": "charge", "depth": 2, "context": False})[1]
        assert call("/v1/query/impact", {"target": "x", "depth": 99})[0] == 422 and call("/v1/query/dsl", {})[0] == 422 and call("/v1/none", {})[0] == 404
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path, PYTHON)
    assert cli.main(["index", str(tmp_path)], spark) == 0
    assert cli.main(["query", "FIND test", "--mode", "dsl", "--repo", str(tmp_path), "--json"], spark) == 0
    out = capsys.readouterr().out
    assert json.loads(out[out.index("{"):])["node_count"] == 3
    assert cli.main(["inspect", "stats", "--repo", str(tmp_path)], spark) == 0
    assert "TESTED_BY          3" in capsys.readouterr().out
    assert cli.main(["query", "buy", "--mode", "impact", "--depth", "50", "--repo", str(tmp_path)], spark) == 1
    assert cli.main(["inspect", "node", "billing.charge", "--depth", "2", "--repo", str(tmp_path)], spark) == 0
    assert cli.main(["inspect", "path", "routes.buy", "billing._open_account", "--max-depth", "1", "--repo", str(tmp_path)], spark) == 0
    assert "_open_account" not in capsys.readouterr().out.split("\n")[-2]
    assert cli.main(["workspace", "init", "--workspace", str(tmp_path)]) == 0
    assert cli.main(["workspace", "add", str(tmp_path), "--id", "me", "--workspace", str(tmp_path)]) == 0
    cli.main(["workspace", "list", "--workspace", str(tmp_path)])
    assert capsys.readouterr().out.startswith("me\t")


def test_stream_of_changes(spark, tmp_path):
    from meshwright.streaming.changes import follow

    root = tmp_path / "r"
    write(root, {"a.py": "def a(): pass\n"})
    ix = indexer(spark, root, tmp_path / "db")
    ix.run(embed=False)
    write(root, {"b.py": "def b(): a()\n"})
    events = tmp_path / "events"
    rows = [("b.py", "h1", "2024-01-01 00:00:00"), ("b.py", "h1", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "rel_path string, content_hash string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(events))
    stream = spark.readStream.schema("rel_path string, content_hash string, at timestamp").parquet(str(events))
    follow(ix, stream, str(tmp_path / "cp")).awaitTermination(120)
    assert ("CALLS", "b.b", "a.a") in edges(ix.store)

"""Updates that cost what changed: equal to a full index after any edit, and no other part of the store touched."""

import os
import random
import subprocess

import pytest
from meshwright.config import Config
from meshwright.index import Indexer
from meshwright.operators import delta, resolve
from meshwright.operators.store import GraphStore
from pyspark.sql import functions as F

from .samples import CONFIG, PYTHON, TYPESCRIPT, write

TABLES = ("nodes", "edges", "raw_edges", "keys", "embeddings", "files")


def indexer(spark, root, db, repo="", store=None):
    return Indexer(spark, Config(repo_path=str(root), repo_id=repo, db_path=str(db), enable_git_enrichment=False), store)


def whole(store):
    """All rows of all tables, but for times and vectors."""
    out = {}
    for t in TABLES:
        rows = store.table(t).drop("modified_ns", "embedding")
        if t == "nodes":
            rows = rows.withColumns({c: F.round(c, 9) for c in ("centrality_score", "importance_score")})
        if t == "embeddings":
            rows = rows.drop("importance_score")  # as of when a node was embedded
        out[t] = sorted(map(str, rows.collect()))
    return out


def fresh(spark, root, tmp, n):
    full = indexer(spark, root, tmp / f"full{n}")
    full.run()
    return whole(full.store)


#: Each edit changes the folder; names come, go, are shared, and paths shadow each other.
EDITS = [
    lambda r: write(r, {"twin.py": "def charge(): pass\n\ndef lonely(): refund(1)\n"}),  # charge stops being unique
    lambda r: (r / "twin.py").write_text("# a comment\ndef charge(): pass\n\ndef lonely(): refund(1)\n"),  # lines move, nothing else
    lambda r: (r / "twin.py").write_text("class charge: pass\n\ndef lonely(): undo_purchase(1)\n"),  # another type
    lambda r: write(r, {"billing/__init__.py": "def other(): pass\n", "pkg/deep.py": "from billing import other\nfrom ..models import Account\n\ndef go():\n    other()\n    charge(1, 2)\n"}),  # two files that an import may name
    lambda r: (r / "billing.py").unlink(),  # what many call goes, and the package takes its place in imports
    lambda r: write(r, {"billing.py": PYTHON["billing.py"].replace("def refund", "def give_back")}),
    lambda r: [(r / "twin.py").unlink(), (r / "types.ts").unlink()],
]


def test_any_edit_equals_a_full_index(spark, tmp_path):
    root = tmp_path / "r"
    write(root, PYTHON | CONFIG | TYPESCRIPT)
    ix = indexer(spark, root, tmp_path / "db")
    ix.run()
    for n, edit in enumerate(EDITS):
        edit(root)
        report = ix.update()
        assert whole(ix.store) == fresh(spark, root, tmp_path, n), n
        if n == 1:
            assert report.resolved_sources == 0 and report.files == 1
        if n == 0:  # the file's own nodes, and those that call charge
            assert 0 < report.resolved_sources < 12


def test_only_edges_that_can_change_are_resolved(spark, tmp_path):
    files = {f"m{i}.py": f"def f{i}(): f{(i + 1) % 40}()\n\ndef g{i}(): helper{i}()\n" for i in range(40)}
    write(tmp_path / "r", files)
    ix = indexer(spark, tmp_path / "r", tmp_path / "db")
    ix.run(embed=False)
    before = {t: ix.store.files(t) for t in TABLES}
    (tmp_path / "r/m7.py").write_text("def renamed(): f8()\n\ndef g7(): helper7()\n")
    report = ix.update(embed=False)
    # The file, its new function and the old one, and f6, which called it.
    assert report.resolved_sources == 4
    for t in ("nodes", "edges", "raw_edges", "files"):
        was, now = before[t], ix.store.files(t)
        part = {now[f] for f in set(now) - set(was)} | {was[f] for f in set(was) - set(now)}
        touched = {"nodes": 40, "edges": 2, "raw_edges": 1, "files": 1}[t]  # ranks of all nodes move with the links
        assert len(part) <= touched, (t, part)


def test_affected_references(spark):
    columns = "repo_id string, node_id string, node_type string, name string, fqn string, file_path string, file_ord string, node_ord int"
    old = spark.createDataFrame([("", "1", "File", "a.py", "a.py", "pkg/a.py", "a", 0), ("", "2", "Function", "f", "pkg.a.f", "pkg/a.py", "a", 1), ("", "3", "Function", "same", "pkg.a.same", "pkg/a.py", "a", 2)], columns)
    new = spark.createDataFrame([("", "3", "Function", "same", "pkg.a.same", "pkg/a.py", "a", 9)], columns)
    assert {(r.role, r.key) for r in delta.affected_references(old, new).collect()} == {("ref", "1"), ("ref", "a.py"), ("ref", "2"), ("ref", "f"), ("ref", "pkg.a.f"), ("base", "pkg/a")}


def test_resolution_among_needed_definitions_equals_that_among_all(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    nodes = spark.createDataFrame([("r", f"id{i}", rng.choice(("Function", "File", "ConfigFile")), rng.choice(names), f"{rng.choice('ab')}.{rng.choice(names)}", f"{rng.choice('ab')}/{rng.choice(names)}{rng.choice(('.py', '.ts', '/index.ts'))}", rng.choice("xyz"), i) for i in range(80)],
                                  "repo_id string, node_id string, node_type string, name string, fqn string, file_path string, file_ord string, node_ord int")
    refs = spark.createDataFrame([("r", rng.choice(("", "a.", "b.", "id")) + rng.choice(names + ["3", "11"]), rng.choice(("", "a/n1", "b/n2", "a/n3", "b/n7"))) for _ in range(200)], "repo_id string, dst_ref string, base string").distinct()
    every = resolve.definitions(nodes)
    needed = resolve.tries(refs).select("repo_id", "role", "key").distinct()
    a, b = (sorted(map(tuple, resolve.resolve_targets(refs, d).collect())) for d in (every, every.join(needed, ["repo_id", "role", "key"], "left_semi")))
    rows = nodes.collect()
    want = []
    for r in refs.collect():
        last = lambda found: max(found, key=lambda n: (n.file_ord, n.node_ord)).node_id if found else None
        by_path = next((p for s in resolve.IMPORT_SUFFIXES if r.base and (p := last([n for n in rows if n.node_type != "Function" and n.file_path == r.base + s]))), None)
        same = [n for n in rows if n.name == r.dst_ref]
        sure = last([n for n in rows if n.node_id == r.dst_ref]) or last([n for n in rows if n.fqn == r.dst_ref]) or by_path
        dst = sure or (same[0].node_id if len(same) == 1 and not r.base else None)
        if dst:
            want.append((r.repo_id, r.dst_ref, r.base, dst, next(n.node_type for n in rows if n.node_id == dst), sure is None))
    assert a == b == sorted(want) and len(want) > 20


def test_history_of_unchanged_files_is_kept_up(spark, tmp_path):
    """A commit changes how often all files were changed, and so their importance, whether or not they are parsed again."""
    root = tmp_path / "r"

    def git(*a):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    def commit(message):
        git("add", "-A")
        git("commit", "-qm", message)

    made = lambda db: Indexer(spark, Config(repo_path=str(root), db_path=str(tmp_path / db)))
    write(root, {"a.py": "def a(): b()\n", "b.py": "def b(): pass\n", "c.py": "def c(): b()\n"})
    git("init", "-q")
    commit("1")
    ix = made("db")
    ix.run(embed=False)
    (root / "a.py").write_text("def a(): c()\n")
    commit("2")
    ix.update(embed=False)
    full = made("full")
    full.run(embed=False)
    assert whole(ix.store) == whole(full.store)
    assert {r.file_path: r.f for r in ix.store.nodes.groupBy("file_path").agg(F.max("change_frequency").alias("f")).collect()} == {"a.py": 1.0, "b.py": 0.5, "c.py": 0.5}


def test_files_are_read_by_size_and_time(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {f"m{i}.py": f"def f{i}(): pass\n" for i in range(30)})
    ix = indexer(spark, root, tmp_path / "db")
    ix.run(embed=False)
    assert ix._compared().count() == 0 and ix._compared(verify=True).count() == 30
    os.utime(root / "m3.py", ns=(1, 1))  # another time, the same content
    (root / "m4.py").write_text("def f4(): f5()\n")
    assert {(r.rel_path, r.change) for r in ix._compared().collect()} == {("m3.py", None), ("m4.py", "modified")}
    assert ix.update(embed=False).files == 1 and ix._compared().count() == 0
    stat = (root / "m5.py").stat()
    (root / "m5.py").write_text("def g5(): pass\n")  # as long as before
    os.utime(root / "m5.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert ix.changes().isEmpty()
    assert [(r.rel_path, r.change) for r in ix.changes(verify=True).collect()] == [("m5.py", "modified")]
    ix.update(verify=True)
    assert whole(ix.store)["nodes"] == fresh(spark, root, tmp_path, 0)["nodes"]


def test_an_update_cut_short_is_made_good(spark, tmp_path, monkeypatch):
    """Broken off after the edges, then after the keys and raw edges, then before the files."""
    root = tmp_path / "r"
    write(root, PYTHON)
    ix = indexer(spark, root, tmp_path / "db")
    ix.run()
    EDITS[0](root)
    merge = GraphStore.merge
    for table in ("keys", "nodes", "files"):
        monkeypatch.setattr(GraphStore, "merge", lambda self, name, *a, at=table: 1 / 0 if name == at else merge(self, name, *a))
        with pytest.raises(ZeroDivisionError):
            ix.update()
    monkeypatch.setattr(GraphStore, "merge", merge)
    ix.update()
    assert whole(ix.store) == fresh(spark, root, tmp_path, 0)


def test_no_repository_touches_the_files_of_another(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "db"))
    made = {}
    for repo in ("one", "two", "three"):
        write(tmp_path / repo, PYTHON)
        made[repo] = indexer(spark, tmp_path / repo, tmp_path / "db", repo, store)
        before = {t: store.files(t) for t in TABLES}
        made[repo].run()
        for t in TABLES:
            assert before[t].items() <= store.files(t).items()
    before = {t: store.files(t) for t in TABLES}
    other = {t: {f for f, p in before[t].items() if p not in store.repo_parts(t, "two")} for t in TABLES}
    EDITS[0](tmp_path / "two")
    made["two"].update()
    made["two"].run()
    some = store.nodes.filter("repo_id = 'two' and file_path = 'models.py'")
    store.upsert("nodes", some.withColumn("docstring", F.lit("changed")))
    store.delete_files(spark.createDataFrame([("two", "routes.py")], "repo_id string, file_path string"))
    for t in TABLES:
        assert other[t] <= set(store.files(t)), t
    mine = store.nodes.filter("repo_id = 'two'")
    assert mine.filter("docstring = 'changed'").count() == mine.filter("file_path = 'models.py'").count() > 0 and mine.filter("file_path = 'routes.py'").isEmpty()
    assert store.nodes.filter("repo_id = 'one'").count() == store.nodes.filter("repo_id = 'three'").count() > 0


def test_merges_leave_readers_their_version(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "db"), buckets=4)
    rows = lambda n: spark.createDataFrame([("", f"f{i}", n, n, f"h{n}") for i in range(20)], "repo_id string, file_path string, size_bytes bigint, modified_ns bigint, content_hash string")
    store.replace("files", rows(1))
    reader = store.table("files")
    store.replace("files", rows(2).limit(7))
    assert reader.filter("size_bytes = 1").count() == 20 and store.table("files").count() == 7
    store.merge("files", store.table("files").limit(0), store.parts("files", rows(1)))
    assert store.table("files").count() == 0 and GraphStore(spark, str(tmp_path / "db")).buckets == 4
    with pytest.raises(ValueError, match="aren't replaced"):
        store.merge("files", rows(3), [])
    assert store.table("files").count() == 0

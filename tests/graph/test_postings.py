"""Search for parts of names by trigrams against plain Python, in tables and in the store."""

import random

import pytest
from meshwright.config import Config
from meshwright.engine import QueryEngine
from meshwright.operators import postings
from meshwright.operators.store import GraphStore

COLUMNS = "repo_id string, node_id string, node_type string, name string, fqn string, file_path string, importance_score double"
NEEDLES = ["abc", "ab", "a", "ba.a", "a%b", "a_b", "日本語", "👩‍👩", "n\nl", "ABC", "zzzz", "aaaa", "", "b" * 100]


def rows(repo="r", n=150, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ab.c_%", k=rng.randint(0, 9)))
    out = [(repo, f"n{i}", "Function", word(), f"{word()}.{word()}", f"f{i % 20}.py", i / n) for i in range(n)]
    return out + [(repo, "odd1", "Class", None, "x.日本語.👩‍👩‍👧", None, 0.1), (repo, "odd2", "Class", "line\nline aaaa", None, "g.py", 0.2), (repo, "odd3", "Class", None, None, "g.py", 0.3), (repo, "odd4", "Class", "b" * 50_000, "", "g.py", 0.3)]


def brute(nodes, needle):
    return sorted((r[0] or "", r[1]) for r in nodes if needle and any(t is not None and needle in t for t in r[3:5]))


def test_tables_of_needles(spark):
    # Two repositories with the same ids, rows without one, a needle given twice, a null.
    nodes = rows() + rows("s", seed=2) + rows(None, 20, 3)
    frame = spark.createDataFrame(nodes, COLUMNS)
    needles = spark.createDataFrame([(n, "clash") for n in [*NEEDLES, "abc", None]], "needle string, gram string")
    got = postings.containing(frame, postings.postings(frame), needles).collect()
    assert sorted(map(tuple, got)) == sorted((n, *hit) for n in NEEDLES for hit in brute(nodes, n))
    empty = frame.limit(0)
    assert postings.containing(empty, postings.postings(empty), needles).count() == postings.containing(frame, postings.postings(frame), needles.limit(0)).count() == 0


def test_needles_meet_no_node_but_by_a_gram(spark):
    frame = spark.createDataFrame(rows(), COLUMNS)
    plan = postings.containing(frame, postings.postings(frame), spark.createDataFrame([("abc",)], "needle string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture()
def store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "graph"), buckets=4)
    s.replace("nodes", spark.createDataFrame(rows() + rows("s", seed=2), COLUMNS + "").selectExpr(*_every(s)))
    return s


def _every(store):
    from meshwright.schema import NODES

    held = {c.split()[0] for c in COLUMNS.split(", ")}
    return [f.name if f.name in held else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in NODES]


def hits(store, needle, repo=None):
    found = store.containing(needle, repo).collect()
    assert len({(r.repo_id, r.node_id) for r in found}) == len(found)
    return sorted((r.repo_id, r.node_id) for r in found if any(t is not None and needle in t for t in (r.name, r.fqn)))


def test_the_store_keeps_postings_up_to_date(spark, store):
    nodes = rows() + rows("s", seed=2)

    def check():
        for n in NEEDLES[:-2]:
            assert hits(store, n) == brute(nodes, n), n
        assert hits(store, "abc", "s") == [h for h in brute(nodes, "abc") if h[0] == "s"]

    check()
    assert store.containing("zzzz").count() == 0 and store.containing("日本語").count() == 2  # candidates alone
    changed = [("r", "n3", "Function", "zzzz", "now zzzz", "f3.py", 0.5), ("r", "new", "Function", "日本語 abc", "", "h.py", 0.5)]
    store.upsert("nodes", spark.createDataFrame(changed, COLUMNS).selectExpr(*_every(store)))
    nodes = [r for r in nodes if r[:2] != ("r", "n3")] + changed
    check()
    store.delete_files(spark.createDataFrame([("r", "h.py"), ("s", "f1.py")], "repo_id string, file_path string"))
    nodes = [r for r in nodes if (r[0], r[5]) not in (("r", "h.py"), ("s", "f1.py"))]
    check()


def test_parts_without_current_postings_are_scanned(spark, store):
    nodes = rows() + rows("s", seed=2)
    part = sorted(store.manifest("nodes"))[0]
    number = store._number("grams")  # as if an update had been cut short between the two writes, or an older version had written
    left = {k: v if k != part else "w0-other" for k, v in store.manifest("grams").items()}
    store._put(f"{store.path}/grams/manifest-{number}", "".join(f"{k}\t{v}\n" for k, v in left.items()))
    for n in ("abc", "日本語", "zzzz"):
        assert hits(store, n) == brute(nodes, n)
    assert store.containing("zzzz").count() == store.table("nodes", [part]).count()


def test_find_reads_candidates(store, spark, tmp_path):
    engine = QueryEngine(spark, Config(repo_path=str(tmp_path), db_path=store.path, repo_id="r"), store)
    for text, needle in (('FIND function WHERE name ~ "abc" LIMIT 500', "abc"), ('FIND WHERE fqn ~ "a.b" AND name ~ a LIMIT 500', None)):
        got = {r["node_id"] for r in engine.query_dsl(text).rows}
        want = {r[1] for r in rows() if (needle in (r[3] or "") and r[2] == "Function" if needle else "a.b" in (r[4] or "") and "a" in (r[3] or ""))}
        assert got == want

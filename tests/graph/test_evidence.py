"""Fixed tables by examples written out, and the queries that SQL doesn't cover, against plain Python."""

import math
from collections import defaultdict

import pytest
from meshwright import queries, testgraph
from meshwright.functions import text as fn
from meshwright.schema import ALLOWED_PAIRS, SYMBOL_TYPES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

TAGS = {
    "authorize": ["authentication"], "checkout": ["payments"], "prepay": ["payments"], "schema": ["data-model"], "spec": ["test"], "endpoint": ["api"], "db": ["database"], "settings": ["config"],
    "helper": ["utility"], "guard": ["middleware"], "migration": ["migration"], "celery": ["async-worker"], "Redis": ["cache"], "metric": ["observability"], "nothing": [], "": [],
    "TestRepositoryConfig": ["test", "database", "config"], "worker queue spec": ["test", "async-worker"], "LOGIN ROUTE": ["api", "observability"],
}
INTENTS = {
    "how does data reach the cache": "path", "flow through the parser": "path", "trace login to db": "path", "How does a call get to b": "path", "path between a and b": "path",
    "what fails if I remove x": "impact", "dependents of X": "impact", "caller of x": "impact", "who imports utils": "impact", "impact of removing x": "impact",
    "what inherits Base": "structural", "which methods use x": "structural", "where is x declared": "structural", "list endpoints": "structural", "show me all classes": "structural", "find functions that parse": "structural",
    "path to enlightenment": "semantic", "": "semantic", "what depends on the path from a to b": "path",
}
PAIRS = {
    "CONTAINS": {"Directory": "File Directory", "File": "Class Function Interface TypeAlias DbModel Test ConfigFile", "Class": "Method"},
    "IMPORTS": {"File": "File"}, "INHERITS": {"Class": "Class"}, "IMPLEMENTS": {"Class": "Interface"},
    "CALLS": {"Function": "Function Method", "Method": "Function Method"}, "READS_FROM": {"Function": "DbModel", "Method": "DbModel"}, "WRITES_TO": {"Function": "DbModel", "Method": "DbModel"},
    "TESTED_BY": {"Function": "Test", "Method": "Test", "Class": "Test"}, "EXPOSES_ENDPOINT": {"Function": "ApiEndpoint", "Method": "ApiEndpoint"}, "DEFINES": {"File": "Function Class Interface TypeAlias"},
}


def test_tags(spark):
    rows = spark.createDataFrame([(k,) for k in TAGS], "t string").select("t", fn.auto_tags(F.col("t")).alias("tags")).collect()
    assert {r.t: r.tags for r in rows} == TAGS


def test_intents(spark):
    rows = spark.createDataFrame([(k,) for k in INTENTS], "q string").select("q", fn.intent(F.col("q")).alias("intent")).collect()
    assert {r.q: r.intent for r in rows} == INTENTS


def test_pairs_and_symbols():
    assert sorted(ALLOWED_PAIRS) == sorted((e, s, d) for e, by in PAIRS.items() for s, ends in by.items() for d in ends.split())
    assert SYMBOL_TYPES == ("Method", "Function", "Test", "ApiEndpoint", "DbModel", "Class", "Interface", "TypeAlias")


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {r.node_id: r for r in testgraph.nodes(spark, SF).collect()}
    return nodes, sorted({(r.edge_type, r.src_id, r.dst_id) for r in testgraph.edges(spark, SF).collect()})


def block(n) -> str:
    parts = [f"## {n.node_type}: `{n.fqn}`"]
    if n.docstring:
        parts.append(f"**Doc:** {n.docstring}")
    lines = f":{n.start_line}" + (f"-{n.end_line}" if n.end_line and n.end_line != n.start_line else "") if n.start_line else ""
    return "\n".join([*parts, f"**File:** `{n.file_path or ''}{lines}`"])


def test_dsl_end_to_end(spark, graph):
    found = sorted((n for n in graph[0].values() if n.node_type == "Class" and "EUROPE" in n.fqn), key=lambda n: (-n.importance_score, n.node_id))[:40]
    top_c, top_i = max(n.centrality_score for n in found), max(n.importance_score for n in found)
    hits = lambda n: sum(t in f"{n.fqn} {n.name}".lower() for t in ("france", "class")) / 2
    score = {n.node_id: 0.25 * n.centrality_score / top_c + 0.2 * hits(n) + 0.1 * n.importance_score / top_i for n in found}
    want, used = [], 0
    for k, n in enumerate(sorted(found, key=lambda n: -score[n.node_id]), 1):
        b, room = block(n), 2800 - len("# Code Context\n\n") - used - 7
        if len(b) > room:
            want += [(k, b[:room] + "\n… [truncated]")] if room > 200 else []
            break
        want.append((k, b))
        used += len(b) + 7
    assert sorted(map(tuple, queries.QUERIES["dsl_end_to_end"](spark, SF).collect())) == want


def test_review_bundle(spark, graph):
    nodes, edges = graph
    testgraph.views(spark, SF, "customer", "nation", "region")
    by_file, touched = defaultdict(list), set()
    for n in nodes.values():
        by_file[n.file_path].append(n)
    for h in spark.sql(queries._HUNKS).collect():
        near = [n for n in by_file[h.file_path] if n.node_type in SYMBOL_TYPES and n.start_line <= h.end_line and n.end_line >= h.start_line]
        if near:
            touched.add(min(near, key=lambda n: (SYMBOL_TYPES.index(n.node_type), n.end_line - n.start_line, n.start_line, n.node_id)).node_id)
        else:
            files = [n for n in by_file[h.file_path] if n.node_type in ("File", "ConfigFile")]
            touched |= {min(files, key=lambda n: (n.node_type == "ConfigFile", n.node_id)).node_id} if files else set()
    back, calls, called = defaultdict(set), defaultdict(set), defaultdict(set)
    for t, a, b in edges:
        if a != b:
            back[b].add(a)
            if t == "CALLS":
                calls[a].add(b)
                called[b].add(a)
    configs = sorted((n for n in nodes.values() if n.node_type == "ConfigFile"), key=lambda n: n.node_id)
    best = {}
    for s in touched:
        upstream = (back[s] | {y for x in back[s] for y in back[x]}) - {s}
        first = sorted(upstream & set(nodes), key=lambda x: (-nodes[x].importance_score, x))[:20]
        listed = [(2, 1, 0, x, "caller") for x in called[s] & set(nodes)] + [(3, 1, 0, x, "callee") for x in calls[s] & set(nodes)] + [(4, 2, k, x, "impacted") for k, x in enumerate(first)]
        places = {}
        for t, tag in enumerate(nodes[s].tags[:3]):
            for k, c in enumerate([c for c in configs if tag in c.tags][:2]):
                places.setdefault(c.node_id, 2 * t + k)
        listed += [(5, 2, k, x, "related_config") for x, k in places.items()]
        for rank, distance, _, x, reason in sorted(listed)[:8]:
            if x not in touched:
                best[x] = min(best.get(x, (9,)), (rank, distance, reason))
    weight = {"touched": 1.0, "caller": 0.55, "callee": 0.4, "impacted": 0.3, "related_config": 0.2}
    every = {x: ("touched", 0) for x in touched} | {x: (reason, d) for x, (_, d, reason) in best.items()}
    score = {x: weight[r] + 0.2 / (1 + d) + 0.2 * nodes[x].importance_score for x, (r, d) in every.items()}
    want = {}
    for path in {nodes[x].file_path for x in every}:
        mine = [x for x in every if nodes[x].file_path == path]
        seeds = [x for x in mine if every[x][0] == "touched"]
        used, n = sum(len(block(nodes[x])) for x in seeds), len(seeds)
        kept = list(seeds) if path is not None else []
        for x in sorted(set(mine) - set(seeds), key=lambda x: (-score[x], x)):
            total = 16 + used + len(block(nodes[x])) + 7 * n
            if path is not None and max(1, math.floor(total / 3.5)) <= 4000:
                used, n = used + len(block(nodes[x])), n + 1
                kept.append(x)
        want |= {x: (*every[x], round(score[x], 6)) for x in kept}
    got = {r.node_id: (r.reason, r.distance, r.score) for r in queries.QUERIES["review_bundle"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][:2] == want[x][:2] and got[x][2] == pytest.approx(want[x][2], abs=2e-6) for x in want)

"""Queries over whole tables against brute force."""

import math
from collections import defaultdict

import pytest
from meshwright import queries, testgraph
from meshwright.operators import packing

TOKENS = 9000
SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").orderBy("doc_id").collect()


def test_context_pack_takes_whole_texts(spark):
    want, used, full = {}, {}, set()
    for r in documents(spark):
        room = 21000 - 16 - used.get(r.lang, 0) - 7
        if r.lang in full:
            continue
        if len(r.text) <= room:
            want[r.doc_id] = r.text
            used[r.lang] = used.get(r.lang, 0) + len(r.text) + 7
        else:
            full.add(r.lang)
            if room > 200:
                want[r.doc_id] = r.text[:room] + packing.TRUNCATED
    got = {r.doc_id: r.block for r in queries.QUERIES["context_pack"](spark, SF).collect()}
    assert got == want and any(len(b) > 900 and not b.endswith(packing.TRUNCATED) for b in got.values())


def test_packing_cuts_each_partition_by_itself(spark):
    rows = [(None, i, "b" * (i % 40)) for i in range(500)] + [("x", i, "c" * 100) for i in range(30)] + [("y", 1, "d" * 5000)]
    blocks = spark.createDataFrame(rows, "lang string, doc_id int, block string")
    got = {}
    for r in packing.pack_prefix(blocks, 800, "", "doc_id", ("lang",)).orderBy("doc_id").collect():
        got.setdefault(r.lang, []).append(r.block)
    for lang in (None, "x", "y"):
        mine = spark.createDataFrame([(i, b) for k, i, b in rows if k == lang], "position int, block string")
        assert got.get(lang, []) == [r.block for r in packing.pack_prefix(mine, 800).orderBy("position").collect()]


def brute_fit(rows, budget):
    """Ids taken of (ord, id, chars)."""
    used, taken = 0, []
    for _, i, chars in sorted(rows):
        total = len(packing.header("")) + used + chars + len(packing.SEPARATOR) * len(taken)
        if max(1, math.floor(total / 3.5)) <= budget:
            used += chars
            taken.append(i)
    return taken


def test_greedy_fit_considers_every_document(spark):
    rows = [(-(len(r.text) % 97), r.doc_id, len(r.text)) for r in documents(spark)]
    want = brute_fit(rows, TOKENS)
    got = sorted(r.doc_id for r in queries.QUERIES["greedy_trim"](spark, SF).collect())
    assert got == sorted(want) and set(want) - {i for _, i, _ in sorted(rows)[:100]}
    frame = spark.createDataFrame(rows, "ord int, id bigint, chars int")
    for chunk in (1, 7):
        few = packing.greedy_fit_all(frame, 700, "claude", chunk)
        assert sorted(r.id for r in few.collect()) == sorted(brute_fit(rows, 700))
    assert packing.greedy_fit_all(frame.limit(0), 700, "claude").count() == 0


@pytest.fixture(scope="module")
def edges(spark):
    return sorted({(r.edge_type, r.src_id, r.dst_id) for r in testgraph.edges(spark, SF).collect()})


def neighbours(edges, direction):
    out = defaultdict(set)
    for _, a, b in edges:
        if direction != "out":
            out[b].add(a)
        if direction != "in":
            out[a].add(b)
    return out


def distances(edges, start, depth, direction):
    near, seen, front = neighbours(edges, direction), {start: 0}, {start}
    for d in range(1, depth + 1):
        front = {b for a in front for b in near[a]} - set(seen)
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.mark.parametrize("name,depth,direction", [("dependents_d3", 3, "in"), ("impact_d4", 4, "in"), ("neighbourhood_d2", 2, "both")])
def test_reach_over_all_edges(spark, edges, name, depth, direction):
    starts = {r.node_id for r in queries._popular(testgraph.edges(spark, SF)).collect()}
    assert len(starts) == 1
    want = distances(edges, *starts, depth, direction)
    got = {r.node_id: r.distance for r in queries.QUERIES[name](spark, SF).collect()}
    assert got == {n: d for n, d in want.items() if d} and {n[0] for n in got} >= {"c", "n", "o"}


def test_paths_over_all_edges(spark, edges):
    a, z, near = min(e[1] for e in edges), max(e[2] for e in edges), neighbours(edges, "both")
    far = distances(edges, z, 6, "both")
    paths = [[a]]
    while paths[0][-1] != z:
        paths = [[*p, n] for p in paths for n in near[p[-1]] if far.get(n) == far[p[-1]] - 1]
    got = [(r.path, r.hops) for r in queries.QUERIES["shortest_path"](spark, SF).orderBy("path").collect()]
    assert got == [(">".join(p), len(p) - 1) for p in sorted(paths)[:3]]


def test_pagerank_over_calls_and_imports(spark, edges):
    links = {(a, b) for t, a, b in edges if t in ("CALLS", "IMPORTS")}
    ids, out = {n for e in links for n in e}, defaultdict(set)
    for a, b in links:
        out[a].add(b)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(10):
        loose = sum(r for n, r in rank.items() if not out[n])
        moved = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * loose / len(ids))
        for a, b in links:
            moved[b] += 0.85 * rank[a] / len(out[a])
        rank = moved
    got = {r.node_id: r["rank"] for r in queries.QUERIES["pagerank_k10"](spark, SF).collect()}
    assert got == pytest.approx(rank, abs=2e-9) and {n[0] for n in got} == {"c", "o", "s"}

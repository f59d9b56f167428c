"""Operators whose work must not grow with pairs, hubs or a driver's memory: against brute force, and their plans."""

import random

import pytest
from meshwright.functions import text as fn
from meshwright.operators import intervals, packing, pagerank, postings, ranking, review, traverse
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Hunks and spans


def test_cover_is_exact_and_small(spark):
    rng = random.Random(1)
    rows = [(0, 0), (0, 3), (3, 4), (0, 2**31 - 1), (1, 2**31 - 1)] + [(a, a + rng.choice([0, 1, 5, 300, 70_000])) for a in (rng.randrange(10**6) for _ in range(60))]
    for r in spark.createDataFrame(rows, "a bigint, z bigint").withColumn("c", intervals.cover(F.col("a"), F.col("z"))).collect():
        spans = sorted(((c & ((1 << 40) - 1)) << 2 * (c >> 40), ((c & ((1 << 40) - 1)) + 1 << 2 * (c >> 40)) - 1) for c in r.c)
        assert spans[0][0] == r.a and spans[-1][1] == r.z and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= 6 * (1 + (r.z - r.a + 1).bit_length() // 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_least_overlapping_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    def span():
        a = rng.randrange(1000)
        return a, a + rng.choice([0, 0, 2, 9, 60, 800])
    nested = [("p", 5 * k, 2000 - 5 * k) for k in range(150)]
    held = [(rng.choice("pq"), *span()) for _ in range(300)] + nested + [("p", 0, 10**6)]
    asked = [(i, rng.choice("pqr"), *span()) for i in range(200)] + [(900, "p", 1500, 1900), (901, "q", 5000, 6000)]
    best = lambda a, z: (z - a, a)
    want = {i: min(found) for i, g, a, z in asked if (found := [best(x, y) for h, x, y in held if h == g and x <= z and y >= a])}
    spans = spark.createDataFrame(held, "g string, low bigint, high bigint").withColumn("best", F.struct((F.col("high") - F.col("low")).alias("n"), "low"))
    got = intervals.least_overlapping(spark.createDataFrame(asked, "i int, g string, low bigint, high bigint"), spans, "g", "i", "best")
    assert {r.i: tuple(r.best) for r in got.collect()} == want


def test_hunks_meet_cells_not_spans(spark):
    """Every hunk overlaps every span of its file: 4 million pairs, of which none is made."""
    n = 2000
    hunks = traverse.materialize(spark.range(n).select(F.col("id").alias("hunk_id"), F.lit("f").alias("file_path"), F.lit(1).alias("start_line"), F.lit(5000).alias("end_line")))
    nodes = traverse.materialize(spark.range(n).select(F.concat(F.lit("s"), "id").alias("node_id"), F.lit("Function").alias("node_type"), F.lit("x").alias("fqn"), F.lit("f").alias("file_path"), F.col("id").cast("int").alias("start_line"), (F.col("id") + 10 + F.col("id") % 7).cast("int").alias("end_line")))
    found = review.narrowest(hunks, nodes)
    assert found.count() == n and {r.node_id for r in found.select("node_id").distinct().collect()} == {"s0"}
    joins = [line for line in plan_of(found).splitlines() if "Join" in line]
    assert joins and all("Cartesian" not in j and "NestedLoop" not in j for j in joins)


# Budgets


def brute_trim(rows, budget, model, estimate):
    head, sep, taken = len(packing.header("")), len(packing.SEPARATOR), []
    chars = sum(c for _, touched, _, c in rows if touched)
    n = sum(touched for _, touched, _, _ in rows)
    for i, touched, _, c in sorted(rows, key=lambda r: (-r[2], r[0] + "\n")):
        if touched:
            taken.append(i)
        elif estimate(head + chars + c + sep * n) <= budget:
            chars, n = chars + c, n + 1
            taken.append(i)
    return set(taken)


@pytest.mark.parametrize("model", ["claude", "gpt-4", "other"])
def test_trim_equals_brute_force(spark, model):
    rng = random.Random(len(model))
    rows = [(f"n{i}", rng.random() < 0.1, rng.randrange(5) / 4, rng.choice([3, 40, 200, 900])) for i in range(200)]
    frame = spark.createDataFrame([(v, i, "touched" if t else "caller", s, c) for v in ("a", "b") for i, t, s, c in (rows if v == "a" else rows[:50])], "review string, node_id string, reason string, score double, chars int")
    for budget in (0, 1, 400, 2000):
        most = fn.most_chars(budget, model)
        estimates = [r.t for r in spark.range(0, most + 20).select(fn.estimate_tokens(F.col("id"), model).alias("t")).collect()]
        assert all((t <= budget) == (n <= most) for n, t in enumerate(estimates))
        estimate = lambda n: estimates[min(n, len(estimates) - 1)]
        got = review.trim(frame, budget, model, ("review",)).collect()
        for v, some in (("a", rows), ("b", rows[:50])):
            assert {r.node_id for r in got if r.review == v} == brute_trim(some, budget, model, estimate)
        assert {r.node_id for r in review.trim(frame.filter("review = 'a'"), budget, model).collect()} == brute_trim(rows, budget, model, estimate)


def test_a_review_of_a_million_candidates(spark):
    rows = spark.range(1_000_000).select(F.format_string("n%07d", "id").alias("node_id"), F.lit("caller").alias("reason"), (1 / (1 + F.col("id"))).alias("score"), F.when(F.col("id") < 5, 100).when(F.col("id") == 999_999, 1).otherwise(10**6).alias("chars"))
    got = review.trim(rows, 1000, "claude")
    assert "collect_list" not in plan_of(got) and {r.node_id for r in got.collect()} == {*(f"n{i:07d}" for i in range(5)), "n0999999"}


# Traversal


def graph(spark, seed, nodes=60, edges=150):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(nodes):02d}", f"n{int(nodes * rng.random() ** 2):02d}") for _ in range(edges)]
    return rows, spark.createDataFrame(rows, "src_id string, dst_id string")


def distances(rows, start):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, level = {start: 0}, [start]
    while level:
        level = sorted({y for x in level for y in near.get(x, ())} - set(seen))
        seen |= dict.fromkeys(level, max(seen.values()) + 1)
    return near, seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_sided_paths_equal_brute_force(spark, seed):
    rows, e = graph(spark, seed, 40, 60)
    near, seen = distances(rows, "n00")
    far = sorted(seen, key=lambda x: (-seen[x], x))
    for dst in (far[0], far[len(far) // 2], "n00", "nowhere"):
        paths = [["n00"]]
        while paths and dst in seen and len(paths[0]) <= seen[dst]:
            paths = [p + [y] for p in paths for y in near[p[-1]] if seen[y] == len(p)]
        want = sorted(p for p in paths if p[-1] == dst)[:3] if dst in seen else []
        got = traverse.shortest_paths(e, "n00", dst, 10).orderBy("path").collect()
        assert [r.path for r in got] == want and all(r.hops == seen[dst] for r in got)
        if dst in seen and seen[dst] > 1:
            assert traverse.shortest_paths(e, "n00", dst, seen[dst] - 1).count() == 0


def test_a_path_of_four_hops_scans_all_steps_twice(spark, monkeypatch):
    """Two levels from both ends, one scan for each pair; the paths themselves come from the steps that were met. Repeats change nothing."""
    e = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("m1", "x"), ("m2", "x"), ("m2", "w"), ("y", "x"), ("y", "z"), ("w", "v")] * 3, "src_id string, dst_id string")
    scans = []
    monkeypatch.setattr(traverse.Adjacency, "steps", property(lambda self: scans.append(1) or self._all, lambda self, df: setattr(self, "_all", df)), raising=False)
    want = [["a", "m1", "x", "y", "z"], ["a", "m2", "x", "y", "z"]]
    assert [r.path for r in traverse.shortest_paths(e, "a", "z").orderBy("path").collect()] == want
    assert len(scans) <= 3  # one asks for the session


@pytest.mark.parametrize("few", [0, 3])
def test_paths_with_large_frontiers_are_the_same(spark, monkeypatch, few):
    rows, e = graph(spark, 4, 40, 60)
    _, seen = distances(rows, "n00")
    dst = max(seen, key=lambda x: (seen[x], x))
    want = [tuple(r.path) for r in traverse.shortest_paths(e, "n00", dst, 10).orderBy("path").collect()]
    monkeypatch.setattr(traverse.Adjacency.__init__, "__defaults__", (few,))
    monkeypatch.setattr(traverse, "HUB_SHARE", 0.05)
    assert [tuple(r.path) for r in traverse.shortest_paths(e, "n00", dst, 10).orderBy("path").collect()] == want and seen[dst] > 3


@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_large_frontiers_reach_the_same(spark, direction, monkeypatch):
    _, e = graph(spark, 5)
    starts = e.select(F.col("src_id").alias("seed"), F.col("src_id").alias("node_id")).distinct()
    want = sorted(map(tuple, traverse.reach(e, starts, 4, direction).collect()))
    monkeypatch.setattr(traverse.Adjacency.__init__, "__defaults__", (0,))
    monkeypatch.setattr(traverse, "HUB_SHARE", 0.05)
    assert sorted(map(tuple, traverse.reach(e, starts, 4, direction).collect())) == want and len(want) > 100


def test_a_level_shuffles_its_frontier_alone(spark):
    """A star of 100,000 edges among others: no exchange lies over the steps, and the hub's aren't in the buckets."""
    star = spark.range(100_000).select(F.lit("hub").alias("src_id"), F.concat(F.lit("n"), "id").alias("dst_id"))
    chain = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("src_id"), F.concat(F.lit("m"), F.col("id") + 1).alias("dst_id"))
    e = star.unionByName(chain)
    starts = traverse.materialize(spark.createDataFrame([("", "s", "hub"), ("", "s", "m0")], "repo_id string, seed string, node_id string"))
    for few, broadcast in ((10, True), (0, False)):
        near = traverse.Adjacency(e, "out", few)
        found = near.ahead(starts, 2)
        assert found.count() == 100_001
        before_distinct = plan_of(found)
        for scan in (line for line in before_distinct.splitlines() if "FileScan" in line and "to#" in line):
            above = before_distinct.splitlines()[: before_distinct.splitlines().index(scan)]
            depth = len(scan) - len(scan.lstrip(" :+-"))
            path = []
            for line in reversed(above):
                d = len(line) - len(line.lstrip(" :+-"))
                if d < depth:
                    path.append(line)
                    depth = d
            below_join = path[: next(i for i, line in enumerate(path) if "Join" in line)]
            assert not any("Exchange" in line for line in below_join), below_join
        if not broadcast:
            hubs, hot, rest = near._buckets()
            assert [r.at for r in hubs.collect()] == ["hub"] and hot.count() == 100_000 and rest.count() == 20_000


# PageRank


def brute_ranks(rows, damping=0.85, rounds=100, tolerance=1e-6):
    out = {}
    for repo in {r for r, _, _ in rows}:
        links = {(a, b) for r, a, b in rows if r == repo}
        ids = {x for link in links for x in link}
        n, degree = len(ids), {i: sum(a == i for a, _ in links) for i in ids}
        rank = dict.fromkeys(ids, 1 / n)
        for _ in range(rounds):
            loose, got = sum(rank[i] for i in ids if not degree[i]), dict.fromkeys(ids, 0.0)
            for a, b in links:
                got[b] += rank[a] / degree[a]
            before, rank = rank, {i: (1 - damping) / n + damping * (got[i] + loose / n) for i in ids}
            if tolerance is not None and sum(abs(rank[i] - before[i]) for i in ids) < n * tolerance:
                break
        out |= {(repo, i): v for i, v in rank.items()}
    return out


@pytest.mark.parametrize("hot_share,local_links", [(0.001, 0), (0.02, 0), (0.001, 10**6)])
def test_page_rank_equals_plain_python(spark, monkeypatch, hot_share, local_links):
    """Cycles, nodes without links, hubs, and repositories that are done at different times."""
    rng = random.Random(3)
    rows = [(r, f"n{rng.randrange(12)}", f"n{int(12 * rng.random() ** 2)}") for r in ("a", "b") for _ in range(30)] + [("a", "n0", f"n{i}") for i in range(12)] + [("c", "x", "y"), ("c", "y", "z")]
    e = spark.createDataFrame(rows, "repo_id string, src_id string, dst_id string")
    monkeypatch.setattr(pagerank, "HOT_SHARE", hot_share)
    for options in ({"tolerance": 1e-3}, {"tolerance": None, "max_iterations": 4}):
        want = brute_ranks(rows, rounds=options.get("max_iterations", 100), tolerance=options["tolerance"])
        assert {(r.repo_id, r.node_id): r["rank"] for r in pagerank.pagerank(e, local_links=local_links, **options).collect()} == pytest.approx(want, abs=1e-12)


# Hot groups


@pytest.mark.parametrize("many", [5, 100_000])
def test_scores_gather_no_set_in_a_task(spark, monkeypatch, many):
    monkeypatch.setattr(ranking, "MANY_ROWS", many)
    rows = [(f"n{i}", ("a", "b", None)[i % 3], i / 7, -float(i), i / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "node_id string, kind string, centrality_score double, importance_score double, semantic_score double").withColumns({"fqn": F.col("node_id"), "name": F.col("node_id"), "input_rank": F.col("node_id")})
    for by in ((), ("kind",)):
        ranked = ranking.rank(df, partition=by)
        assert "Window" not in plan_of(ranked.select("node_id", "score"))
        groups = {}
        for r in rows:
            groups.setdefault(r[1] if by else 0, []).append(r)
        want = {}
        for found in groups.values():
            c, i = (max(r[k] for r in found) or 1.0 for k in (2, 3))
            want |= {r[0]: 0.35 * r[4] + 0.25 * r[2] / c + 0.1 * r[3] / i for r in found}
        got = ranked.collect()
        assert {r.node_id: r.score for r in got} == pytest.approx(want)
        assert sorted(r.position for r in got) == sorted(k + 1 for found in groups.values() for k in range(len(found)))


def test_grams_are_counted_where_they_lie(spark):
    """A gram that all nodes have is counted by the tasks that hold its rows before any row is sent."""
    table = traverse.materialize(spark.range(20_000).select(F.lit("").alias("repo_id"), F.explode(F.array(F.lit("com"), F.concat(F.lit("x"), (F.col("id") % 90).cast("string")))).alias("gram"), F.lit("f").alias("file_path"), F.col("id").cast("string").alias("node_id")))
    needles = spark.createDataFrame([("com",), ("comx12",), ("zzz",)], "needle string")
    found = postings.rarest(table, needles)
    assert {r.needle: r.gram for r in found.collect()} == {"com": "com", "comx12": "mx1", "zzz": "zzz"}
    assert "LeftSemi" not in plan_of(found)
    nodes = spark.range(300).select(F.lit("").alias("repo_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("com"), "id").alias("name"), F.lit(None).cast("string").alias("fqn"), F.lit("f").alias("file_path"))
    met = postings.containing(nodes, traverse.materialize(postings.postings(nodes)), needles.unionByName(spark.createDataFrame([("om",), ("7",)], "needle string")))
    assert met.filter("needle = 'om'").count() == 300 and met.filter("needle = '7'").count() == sum("7" in str(i) for i in range(300)) and met.filter("needle = 'com'").count() == 300
    assert [j for j in plan_of(met).splitlines() if "LeftSemi" in j and "BroadcastHashJoin" in j] and not [j for j in plan_of(met).splitlines() if "LeftSemi" in j and "BroadcastHashJoin" not in j]

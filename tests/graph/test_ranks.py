"""Ranks over parts: what a round moves, how nodes are dealt, and the numbers that stand for nodes of the test tables."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from meshwright import queries, tables, testgraph
from meshwright.operators import pagerank

SF = "/root/testdata/sf0.001"


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of run() shuffle."""
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(stages()))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_a_round_moves_a_row_for_each_pair_of_parts(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randrange(3000)}", f"n{rng.randrange(3000)}") for _ in range(9000)]
    e = tables.materialize(spark.createDataFrame(rows, "src_id string, dst_id string"))
    options = {"tolerance": None, "local_links": 0, "rows": len(rows)}
    few, many = (shuffled_rows(spark, lambda k=k: pagerank.pagerank(e, max_iterations=k, **options)) for k in (1, 5))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    assert 0 < many - few <= 4 * (parts**2 + 10 * parts)


def brute(rows, rounds: int) -> dict:
    rows, rank = set(rows), {}
    for repo in {r[0] for r in rows}:
        links = [r[1:] for r in rows if r[0] == repo]
        ids = {i for link in links for i in link}
        out = {i: sum(a == i for a, _ in links) for i in ids}
        now = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(rounds):
            fresh = dict.fromkeys(ids, (0.15 + 0.85 * sum(v for i, v in now.items() if not out[i])) / len(ids))
            for a, b in links:
                fresh[b] += 0.85 * now[a] / out[a]
            now = fresh
        rank |= {(repo, i): v for i, v in now.items()}
    return rank


@pytest.mark.parametrize("near,hot_share", [(None, 0.001), (lambda c: F.shiftright(c, 4), 0.001), (lambda c: F.shiftright(c, 4), 0.9), (lambda c: F.lit(None), 0.9)])
def test_parts_change_no_rank(spark, monkeypatch, near, hot_share):
    """Ids that are numbers; many small repositories beside a large one; a hub on either side; a cell that is more than a part."""
    monkeypatch.setattr(pagerank, "HOT_SHARE", hot_share)
    monkeypatch.setattr(tables, "ROWS_A_BUCKET", 40)
    rng = random.Random(5)
    rows = [("a", rng.randrange(90) - 20, rng.randrange(90) - 20) for _ in range(250)] + [("a", 7, i) for i in range(70)] + [("a", i, 9) for i in range(60)] + [(f"r{i % 9}", i % 4, i % 5) for i in range(60)]
    e = spark.createDataFrame(rows, "repo_id string, src_id long, dst_id long")
    ranks = pagerank.pagerank(e, max_iterations=4, tolerance=None, local_links=0, near=near)
    got = {(r.repo_id, r.node_id): r["rank"] for r in ranks.collect()}
    assert got == pytest.approx(brute(rows, 4), abs=1e-14)
    assert {(r.repo_id, r.node_id): r["rank"] for r in pagerank.pagerank(e, max_iterations=4, tolerance=None).collect()} == pytest.approx(got, abs=1e-14)


def test_sources_that_are_hot_lie_with_their_targets(spark, monkeypatch):
    """No part holds a hub's links alone."""
    monkeypatch.setattr(tables, "ROWS_A_BUCKET", 200)
    e = spark.createDataFrame([("", "hub", f"n{i}") for i in range(2000)] + [("", f"n{i}", f"n{i + 1}") for i in range(300)], "repo_id string, src_id string, dst_id string")
    parts, _ = pagerank._parts(e, 2300, None)
    sent, got = parts.agg(F.max(F.length("sent")), F.max(F.length("hot_got"))).first()
    assert max(sent, got) < 4 * 1000
    assert parts.agg(F.sum(F.length("hot_got"))).first()[0] == 4 * 2000


def test_links_are_the_edges_of_the_text(spark):
    for types in ((), ("CALLS", "IMPORTS"), ("READS_FROM",), ("CONTAINS", "WRITES_TO")):
        links = testgraph.links(spark, SF, *types)
        text = spark.sql(testgraph.EDGES_SQL).filter(F.col("edge_type").isin(*types) if types else F.lit(True)).select("src_id", "dst_id").distinct()
        assert dict(links.dtypes)["src_id"] == "bigint"
        named = testgraph.node_name(testgraph.node_name(links.withColumn("first", testgraph.sorts_first(links, "dst_id", "src_id")), "src_id"), "dst_id")
        assert named.filter(F.col("first") != (F.col("dst_id") < F.col("src_id"))).isEmpty()
        named = named.select("src_id", "dst_id").distinct()
        assert named.exceptAll(text).isEmpty() and text.exceptAll(named).isEmpty()


@pytest.mark.parametrize("far", [0, 1 << 61])
def test_odd_keys_rank_as_in_sql(spark, tmp_path, far):
    """Keys that are null, negative, or too large for a number with a letter's place; repeated lines."""
    con = duckdb.connect()
    made = {
        "nation": "SELECT i::BIGINT AS n_nationkey, (i % 2)::BIGINT AS n_regionkey FROM range(3) t(i)",
        "customer": "SELECT CASE WHEN i = 4 THEN NULL ELSE i END::BIGINT AS c_custkey, (i % 3)::BIGINT AS c_nationkey FROM range(9) t(i)",
        "supplier": "SELECT (i - 2)::BIGINT AS s_suppkey, CASE WHEN i <> 1 THEN i % 3 END::BIGINT AS s_nationkey FROM range(5) t(i)",
        "orders": f"SELECT (i - 3 + CASE WHEN i > 20 THEN {far} ELSE 0 END)::BIGINT AS o_orderkey, CASE WHEN i % 7 <> 2 THEN i % 9 END::BIGINT AS o_custkey, CASE WHEN i % 3 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(30) t(i)",
        "lineitem": "SELECT CASE WHEN i % 17 <> 3 THEN i % 25 - 3 END::BIGINT AS l_orderkey, CASE WHEN i % 11 <> 5 THEN i % 5 - 2 END::BIGINT AS l_suppkey, CASE WHEN i % 13 <> 1 THEN i % 12 END::BIGINT AS l_partkey, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM (SELECT unnest([i, i]) AS i FROM range(80) t(i))",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0], r[1] or ""))
    got = order(queries.QUERIES["pagerank_two_repositories"](spark, str(tmp_path)).select("repo_id", "node_id", "rank").collect())
    want = order(con.execute(queries.ORACLE_SQL["pagerank_two_repositories"]).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-9)

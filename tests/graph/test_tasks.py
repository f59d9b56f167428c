"""What one task holds is bounded: by rows, whatever the number of shuffle partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshwright import queries, tables, testgraph
from meshwright.operators import find, intervals, pagerank, review, traverse

SF = "/root/testdata/sf0.001"


def most_in_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_edges_are_those_of_the_text_and_no_task_drops_repeats_of_many(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    edges, text = testgraph.edges(spark, SF), spark.sql(testgraph.EDGES_SQL)
    assert edges.schema == text.schema
    assert edges.exceptAll(text).isEmpty() and text.exceptAll(edges).isEmpty()
    assert most_in_a_task(edges.filter("edge_type in ('READS_FROM', 'WRITES_TO', 'IMPLEMENTS') or src_id like 'o%'")) < 1000


def test_edges_with_repeats_are_the_same_ones_and_lines_of_orders_are_not_shuffled(spark):
    once, repeated = testgraph.edges(spark, SF), testgraph.edges(spark, SF, repeats=True)
    assert once.exceptAll(repeated).isEmpty() and repeated.distinct().exceptAll(once).isEmpty()
    dealt = lambda df: df._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression")
    assert dealt(once) - dealt(repeated) == 3


def test_counts_deal_a_hub_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    counted = tables.counts_by(rows, 2000, "key")
    assert counted.filter("key = 0").first().n == 1000 and counted.count() == 1001 and counted.agg(F.sum("n")).first()[0] == 2000
    assert "_salt" in counted._jdf.queryExecution().toString()


def test_most_popular_node(spark):
    edges = tables.materialize(testgraph.edges(spark, SF))
    first = edges.groupBy("dst_id").count().orderBy(F.desc("count"), "dst_id").first().dst_id
    assert queries._popular(edges).first().node_id == first


def test_known_rows_deal_repeated_hops_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    nodes, edges = queries.graph(spark, SF)
    ids = nodes.filter("node_type = 'Interface'")
    rows = testgraph.most_edges(spark, SF, "CALLS")
    assert rows >= edges.filter("edge_type = 'CALLS'").count()
    a, b = find.callers(nodes, edges, ids).select("anchor", "node_id"), find.callers(nodes, edges, ids, rows).select("anchor", "node_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_written_edges_are_not_written_again(spark):
    edges = tables.materialize(testgraph.edges(spark, SF))
    before = len(tables._kept)
    near = traverse.Adjacency(edges, "both", written=True)
    assert len(tables._kept) == before
    again = traverse.Adjacency(edges, "both")
    assert near.steps.exceptAll(again.steps).isEmpty() and again.steps.exceptAll(near.steps).isEmpty()


@pytest.mark.parametrize("rows", [None, 30_000])
def test_ranks_in_more_buckets_than_partitions(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 2000)
    monkeypatch.setattr(tables, "ROWS_A_BUCKET", 300)
    links = testgraph.edges(spark, SF).withColumn("repo_id", F.explode(F.array(F.lit("A"), F.lit("B"))))
    options = {"max_iterations": 3, "tolerance": None}
    ranks = pagerank.pagerank(links, local_links=0, rows=rows, **options)
    assert len(ranks.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(r.repo_id, r.node_id): r.rank for r in pagerank.pagerank(links, **options).collect()}
    assert {(r.repo_id, r.node_id): r.rank for r in ranks.collect()} == pytest.approx(want, rel=1e-9)


def test_a_small_review_shuffles_neither_edges_nor_nodes(spark, monkeypatch):
    """Where what is near the seeds is small, it is sent to the tables; only what it meets there is made distinct."""
    nodes = tables.materialize(spark.range(50_000).select(F.lit("").alias("repo_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.lit("Function").alias("node_type"), (F.col("id") % 1009 / 1009).alias("importance_score"), F.array().cast("array<string>").alias("tags")))
    edges = tables.materialize(spark.range(100_000).select(F.lit("CALLS").alias("edge_type"), F.concat(F.lit("n"), F.col("id") * 7919 % 50_000).alias("src_id"), F.concat(F.lit("n"), F.col("id") % 50_000).alias("dst_id")))
    seeds = tables.materialize(nodes.filter("node_id in ('n1', 'n2', 'n3')").select("repo_id", "node_id", "tags"))
    want = {tuple(r) for r in review.expand(seeds, nodes, edges).collect()}
    plans, write = [], review.materialize

    def recorded(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a)

    monkeypatch.setattr(review, "materialize", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        found = review.expand(seeds, nodes, edges)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert {tuple(r) for r in found.collect()} == want and len(want) >= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [p for p in plans if "SortMergeJoin" in p]


def test_hunks_of_the_same_lines_ask_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("", f"n{i:02d}", "Function", f"f{i}", "a.py", 10 * (i % 5), 10 * (i % 5) + 9) for i in range(50)], "repo_id string, node_id string, node_type string, fqn string, file_path string, start_line int, end_line int")
    hunks = spark.range(600).selectExpr("id as ord", "id as hunk_id", "'a.py' as file_path", "cast(id % 6 * 10 + 1 as int) as start_line", "cast(id % 6 * 10 + 2 as int) as end_line", "false as is_new", "false as is_deleted")
    asked, least = [], intervals.least_overlapping
    monkeypatch.setattr(intervals, "least_overlapping", lambda probes, *a: asked.append(probes.count()) or least(probes, *a))
    got = {r.hunk_id: r.node_id for r in review.narrowest(hunks, nodes).collect()}
    assert got == {i: f"n{i % 6:02d}" for i in range(600) if i % 6 < 5} and asked == [6]
    assert {(r.node_id, r.ord) for r in review.seeds(hunks, nodes).collect()} == {(f"n{i:02d}", float(i)) for i in range(5)}

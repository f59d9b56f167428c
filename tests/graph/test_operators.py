"""Operators against definitions, and every registered query against its SQL."""

import duckdb
import pytest
from meshwright import queries
from meshwright.operators import packing, pagerank, ranking, review, traverse
from meshwright.plans import dsl
from meshwright.sources.repository import glob_regex
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        want = oracle.execute(queries.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b)


def test_golden_intents(spark):
    got = queries.intent_classify(spark, SF).filter(F.col("q").isin(*queries.GOLDEN_QUESTIONS)).collect()
    want = dict(zip(queries.GOLDEN_QUESTIONS, ["path"] * 2 + ["impact"] * 3 + ["structural"] * 3 + ["semantic"] * 2))
    assert {r.q: r.intent for r in got} == want


@pytest.mark.parametrize("depth,high,error", [(1, 10, None), (10, 10, None), (0, 10, ValueError), (-1, 10, ValueError), (11, 10, ValueError), (15, 20, None), (21, 20, ValueError), (True, 10, TypeError), ("2", 10, TypeError), (2.5, 10, TypeError)])
def test_depth_guard(depth, high, error):
    if error:
        with pytest.raises(error):
            traverse.checked_depth(depth, 1, high)
    else:
        assert traverse.checked_depth(depth, 1, high) == depth


def test_dsl_trees():
    assert dsl.parse("find METHOD where name ~ 'a b' AND file = x limit 3") == dsl.Find("METHOD", [("name", "~", "a b"), ("file", "=", "x")], 3)
    assert dsl.parse("FIND unknown") == dsl.Find() and dsl.parse("") is None and dsl.parse("DROP x") is None
    assert dsl.parse('IMPACT "a.b" DEPTH 5') == dsl.Reach("a.b", 5) and dsl.parse("DEPENDENTS x") == dsl.Reach("x") and dsl.parse("DEPENDENTS") == dsl.Reach("")
    assert dsl.parse("PATH FROM a TO 'b c'") == dsl.Path("a", "b c")
    with pytest.raises(ValueError):
        dsl.parse("FIND * LIMIT x")


def test_pagerank_converges_and_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "b"), ("c", "e")], "src_id string, dst_id string")
    ranks = {r.node_id: r["rank"] for r in pagerank.pagerank(e, tolerance=1e-12).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] == max(ranks.values()) and set(ranks) == set("abcde")
    assert pagerank.pagerank(e.limit(0)).count() == pagerank.pagerank(e.limit(0), local_links=-1).count() == 0


@pytest.mark.parametrize("hot_share", [0.001, 0.3])
def test_pagerank_over_tables_equals_that_of_one_task(spark, monkeypatch, hot_share):
    import random

    rng = random.Random(3)
    rows = [(r, f"n{rng.randrange(12)}", f"n{int(12 * rng.random() ** 2)}") for r in ("a", "b", "c") for _ in range(30)] + [("a", "n0", f"n{i}") for i in range(12)]
    e = spark.createDataFrame(rows, "repo_id string, src_id string, dst_id string")
    monkeypatch.setattr(pagerank, "HOT_SHARE", hot_share)
    for options in ({"tolerance": 1e-4}, {"tolerance": None, "max_iterations": 4}):
        one, many = ({(r.repo_id, r.node_id): r["rank"] for r in pagerank.pagerank(e, local_links=n, **options).collect()} for n in (10**6, 0))
        assert one == pytest.approx(many, abs=1e-12) and len(one) > 30


def test_reach_handles_cycles_and_many_seeds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("a", "a")], "src_id string, dst_id string").withColumn("edge_type", F.lit("CALLS"))
    starts = spark.createDataFrame([("a", "a"), ("c", "c")], "seed string, node_id string")
    got = {(r.seed, r.node_id): r.distance for r in traverse.reach(e, starts, 5).collect()}
    assert got == {("a", "a"): 0, ("a", "c"): 1, ("a", "x"): 1, ("a", "b"): 2, ("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 2, ("c", "x"): 3}
    assert traverse.reach(e, starts, 5, edge_types=["IMPORTS"]).count() == 2


def test_shortest_paths_are_the_first_three(spark):
    e = spark.createDataFrame([("s", m) for m in "dcba"] + [(m, "t") for m in "abcd"] + [("t", "z")], "src_id string, dst_id string")
    assert ["".join(r.path) for r in traverse.shortest_paths(e, "s", "t").orderBy("path").collect()] == ["sat", "sbt", "sct"]
    assert traverse.shortest_paths(e, "s", "nowhere").count() == 0
    assert traverse.shortest_paths(e, "z", "s", max_depth=2).count() == 0


def test_rank_order_and_empty(spark):
    rows = [("lo", .1, .1), ("hi", .9, .9), ("mid", .5, .5)]
    df = spark.createDataFrame(rows, "node_id string, centrality_score double, semantic_score double").withColumns({"importance_score": F.lit(0.0), "fqn": F.col("node_id"), "name": F.col("node_id"), "input_rank": F.col("node_id")})
    assert [r.node_id for r in ranking.rank(df).orderBy("position").collect()] == ["hi", "mid", "lo"]
    assert ranking.rank(df.limit(0)).count() == 0


def test_packing_limits(spark):
    blocks = spark.createDataFrame([(i, "b" * 200) for i in range(20)], "position int, block string")
    text = packing.packed_text(packing.pack_prefix(blocks, 500, "q"), "q")
    assert len(text) <= 500 * 3.5 + len(packing.TRUNCATED) and text.startswith(packing.header("q"))
    assert packing.packed_text(packing.pack_prefix(blocks.limit(0), 500)) == "# Code Context\n\n"


def test_candidate_scores_are_ordered_by_reason(spark):
    rows = [(r, {"touched": 0, "impacted": 2, "related_config": 2}.get(r, 1), 0.1 if r == "touched" else 0.9) for r in review.REASON_WEIGHT]
    df = spark.createDataFrame(rows, "reason string, distance int, importance double")
    got = df.orderBy(F.desc(review.score(F.col("reason"), F.col("distance"), F.col("importance")))).collect()
    assert [r.reason for r in got] == list(review.REASON_WEIGHT)


def test_glob():
    import re

    m = lambda p, s: bool(re.match(glob_regex([p]), s))
    assert m("**/dist/**", "a/dist/b/c") and m("*.py", "a/b.py") and not m("*.py", "a.pyc") and not re.match(glob_regex([]), "x") and m("a?c", "abc")


def test_materialized_tables_are_released(spark):
    from meshwright import tables

    tables.release(spark)
    df = tables.materialize(spark.range(5).withColumn("s", F.lit("x")))
    assert df.count() == 5 and df.columns == ["id", "s"]
    assert tables.release(spark) == 1 and tables.release(spark) == 0

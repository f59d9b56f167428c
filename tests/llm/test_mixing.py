"""Mixing: targets against repeated resharing, taken words against the quota, the schedule's evenness."""

import random
import re
from collections import Counter

import pytest
from meshwright.llm import mixing
from pyspark.sql import functions as F


def brute_targets(sizes):
    """{source: target} by resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("case", range(4))
def test_mix(spark, case):
    rng = random.Random(case)
    sources = [["a", "b", "c"], ["a", "é", "z", "Z", None], ["one"], [f"s{i}" for i in range(30)] + [None]][case]
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8)))[:4000], rng.choice(sources[: 1 + int(len(sources) * rng.random() ** 2)])) for i in range(700)]
    rows += [(5, None, sources[0]), (6, " \n ", sources[-1]), (7, "x y", sources[0]), (7, "x y", sources[0]), (None, "a b c", sources[-1])]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, source string, size int, rank int").repartition(4)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, ((r.doc_id, r.size, r.taken, r.first_slot) for r in got))) == sorted(map(repr, ((r.doc_id, r.size, r.taken, r.first_slot) for r in again)))
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 0.0, 0.6), (1, 0.6, 0.9), (2, 0.9, 1.0)], "src int, lo double, hi double")
    slots = sorted((r.slot, r.src, r["rank"]) for r in mixing.golden_slots(spark, 20000, sources).collect())
    assert [s for s, _, _ in slots] == list(range(20000))
    seen = Counter()
    for n, src, rank in slots:
        assert rank == seen[src]
        seen[src] += 1
        assert all(abs(seen[i] - p * (n + 1)) < 5 for i, p in enumerate((0.6, 0.3, 0.1)))


def test_documents_and_empty(spark):
    rows = [(i, f"text {i} " * 20, "a" if i % 4 else "b") for i in range(400)] + [(9000, "", "a"), (1, "text 1 " * 20, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("x"))
    mixed = mixing.mixed_documents(docs.withColumn("k_id", F.lit("mine")))
    assert mixed.columns == [*docs.columns, "k_id"] and mixed.filter("copies <> 'x' or k_id <> 'mine'").count() == 0
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    goal = brute_targets({"a": 301 * 40, "b": 100 * 40})
    assert all(abs(words[s] - goal[s]) <= 40 for s in goal)
    assert mixed.filter("doc_id = 9000").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("doc_id = 9000")).first().taken == 0


def test_reruns_agree_on_equal_ids_and_very_long_texts(spark):
    rows = [(i % 20, f"t{i} " * 30, "a") for i in range(300)] + [(i, f"u{i} " * 30, "b") for i in range(300)] + [(999, "long " * 400_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = lambda n: sorted((r.doc_id, r.text[:9]) for r in mixing.mixed_documents(docs.repartition(n, F.rand(n))).collect())
    first = taken(2)
    assert first == taken(7) and any(x[0] < 20 for x in first)
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.doc_id == 999}
    assert 0 < got[999] <= 3 * 400_000


def test_block_size_is_the_same_at_every_size(spark):
    docs = spark.createDataFrame([(i, "w " * 512, "a") for i in range(40)], "doc_id bigint, text string, source string")
    slots = sorted(r.first_slot for r in mixing.mix(docs).collect())
    assert slots == list(range(0, 80, 2))

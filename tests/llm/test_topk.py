"""Exact top-k against brute force, with ties, odd vectors and several query groups."""

import math
import random

from meshwright.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    ok = [(i, v) for i, v in ok if max(map(abs, v)) < 2**62]
    for q in sorted({i for i, _ in ok if i % 5 == 0}):
        scores = sorted((-s, i) for qv in {tuple(v) for i, v in ok if i == q} for i, v in ok if i != q and len(v) == len(qv) and abs(s := sum(a * b for a, b in zip(qv, v))) < 2**62)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted((q, *x) for q, v in out.items() for x in v)


def found(spark, rows, k):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, score string").repartition(5)
    return sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 5 == 0, k).collect())


def test_random_and_ties(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.25] * 4) for i in range(150, 400)]  # one common vector: long ties at the kth score
    rows += [(401, None), (402, []), (405, [1.0, None, 0.0, 0.0]), (410, [math.nan] * 4), (415, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (7, [0.25] * 4), (10, rows[10][1])]
    assert found(spark, rows, 10) == brute(rows, 10)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    assert found(spark, rows, 3) == brute(rows, 3)


def test_wide_range_and_few_candidates(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(8)]) for i in range(120)] + [(500, [1.0, 2.0]), (501, [3.0, -1.0]), (505, [9.0] * 3)]
    assert found(spark, rows, 10) == brute(rows, 10)
    assert found(spark, rows[:6], 10) == brute(rows[:6], 10)
    assert found(spark, rows[:1], 10) == found(spark, [], 10) == []


def test_scores_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(0, 14) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e300, 0.0, 0.0, 0.0]), (101, [4e6] * 4), (102, [2e7] * 4), (105, [3e15, 0.0, 0.0, 0.0]), (106, [1e-3, 5.0, 5.0, 5.0]), (110, [-4.6e15, 1.0, 1.0, 1.0])]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_products_equal_python_integers():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (10, 10**7, 10**9, 3 * 10**9, 10**15):
        q, r = rng.integers(-size, size, (6, 5)), rng.integers(-size, size, (9, 5))
        got, fits = topk.products(q, r)
        for i in range(6):
            for j in range(9):
                want = sum(int(a) * int(b) for a, b in zip(q[i], r[j]))
                assert fits[i, j] == (abs(want) < 2**62) if fits is not None else abs(want) < 2**62
                assert got[i, j] == want or not fits[i, j]


def test_several_vectors_of_a_query(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [0.5, 0.5])]
    assert found(spark, rows, 3) == brute(rows, 3)

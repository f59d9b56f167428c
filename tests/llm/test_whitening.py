"""Whitening against plain numpy and Python integers, and its own covariance."""

import math

import numpy as np
import pytest
from meshwright.llm import whitening
from pyspark.sql import functions as F


def check(got, vectors, components):
    """Whether rows are those of vectors {id: list}, up to the sign of a component."""
    rows = got.collect()
    ids = sorted(vectors)
    x = [[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in ids]
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    exact = [[n * v - s for v, s in zip(r, sums)] for r in x]
    deviation = {i: sum(v * v for v in r) for i, r in zip(ids, exact)}
    centred = np.array(exact, dtype=float) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    k = min(components, d)
    assert len(rows) == n * k and {r.n for r in rows} == {n} and all(r.deviation == deviation[r.vec_id] for r in rows)
    w = np.zeros((n, k))
    at = {i: p for p, i in enumerate(ids)}
    for r in rows:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[-r.component] / np.trace(cov), rel=1e-9)
    want = centred @ v[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])
    assert np.minimum(np.abs(w - want).max(axis=0), np.abs(w + want).max(axis=0)).max() < 1e-6
    inner = w - w.mean(axis=0)
    assert rows[0].identity_error == pytest.approx(np.abs(inner.T @ inner / n - np.eye(k)).max(), abs=1e-9) and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-8


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("dims,components", [(12, 8), (3, 8), (5, 2)])
def test_against_numpy(spark, dims, components):
    rng = np.random.default_rng(dims)
    spread = rng.normal(size=(dims, dims)) + 3 * np.eye(dims)
    vectors = {i: np.float32(rng.normal(size=dims) @ spread).tolist() for i in range(200)}
    check(whitening.whiten(frame(spark, list(vectors.items())), components), vectors, components)


def test_defined_results(spark):
    rng = np.random.default_rng(1)
    good = {i: np.float32(rng.normal(size=4)).tolist() for i in range(30)}
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("-inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    docs = frame(spark, list(good.items()) + odd).withColumns({"x": F.lit("clash"), "c": F.lit(1), "w": F.lit(2), "n": F.lit(3)})
    check(whitening.whiten(docs), good, 8)
    assert whitening.whiten(docs.filter("vec_id >= 100 and vec_id < 105")).collect() == []
    assert whitening.whiten(docs.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_ids_and_repeated_rows(spark):
    big = (1 << 62) + 1  # an id that a double can't hold
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (big, [2.0, 0.5]), (5, [0.0, 0.25])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1), (5, 2), (big, 1), (big, 2)]
    assert {r.n for r in got} == {4}


def test_components_without_variance(spark):
    """The third entry is the sum of the others, the fourth constant: two components can be scaled."""
    rng = np.random.default_rng(2)
    rows = [(i, [a / 1024, b / 1024, (a + b) / 1024, 0.5]) for i, (a, b) in enumerate(rng.integers(-400, 400, (50, 2)).tolist())]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 200 and all((r.whitened is None) == (r.component > 2) for r in got) and got[0].identity_error < 1e-8
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.deviation, r.whitened, r.identity_error) for r in one] == [(0, None, 0.0)] * 2


def test_deviation_beyond_doubles_and_longs(spark):
    n = 9
    rows = [(i, [float(1 << 19) * i, float(3 * i)]) for i in range(n)]
    x = [[1024 * int(c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: v if v < 2**63 else None for i, v in enumerate(want)} and None in got.values() and max(filter(None, want)) > 2**53

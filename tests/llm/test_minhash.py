"""Circulant MinHash against brute force: every pair of shingle sets is compared, links are closed by union-find."""

import random

import numpy as np
import pytest
from meshwright.llm import minhash
from pyspark.sql import functions as F


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    """{doc_id: (n_shingles, component_id)} of (id, text)."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return {i: (len(s), root[i]) for i, s in sets}


def edited(rng):
    """Families by chains of edits, and a star: a text and copies that are similar to it but not to each other."""
    rows = [(900, None), (901, " \n"), (902, "a"), (903, "A"), (904, "É b"), (905, "é b"), (906, "x y"), (907, "X\tY")]
    for g in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 300]))]
        for k in range(rng.randint(1, 12)):
            rows.append((g * 20 + k, " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(5000)}"
    base = [f"b{i}" for i in range(200)]
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(200), 11 if k else 0):
            copy[at] = f"c{k}_{at}"
        rows.append((2000 - k, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(7, 1024), (8, 3)])
def test_edited_texts(spark, seed, block):
    rows = edited(random.Random(seed))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_exactly_at_the_least_similarity(spark):
    """8 of 10 shingles are shared, then 79 of 99."""
    one = [f"s{i}" for i in range(10)]
    at = [(1, " ".join(one)), (2, " ".join(one[:9] + ["other"]))]  # 9 shingles each, 8 shared of 10
    two = [f"t{i}" for i in range(90)]
    below = [(3, " ".join(two)), (4, " ".join(two[:80] + [f"u{i}" for i in range(10)]))]  # 89 each, 79 shared of 99
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(at + below, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_defined_results(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base.upper()), (9, base.replace("w150", "other")), (None, base), (None, "alone here"), (11, None), (8, " "), (12, "y z " * 300_000), (13, "y z " * 300_001), (12, "y z " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit("clash"), "key": F.lit(1), "set": F.lit(2), "root": F.lit(3)})
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (5, 299, 3, False), (3, 299, 3, True), (9, 299, 3, False), (None, 299, 3, False), (None, 1, None, True), (11, 0, 11, True), (8, 0, 8, True), (12, 2, 12, True), (13, 2, 12, False), (12, 2, 12, True)]))
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_coordinates_are_shifts_of_one_permutation_and_agree_as_often_as_sets():
    first, windows = minhash.permutations()
    size = 1 << minhash.UNIVERSE_BITS
    assert sorted(first.tolist()) == list(range(size)) and sorted(windows[:, 0].tolist()) == list(range(size))
    assert all((windows[(at + 3) % size, :-3] == windows[at, 3:]).all() for at in (0, 17, size - 3, size - 1))
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(60):
            n = 400
            shared = int(2 * n * similarity / (1 + similarity))
            a, b, c = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (shared, n - shared, n - shared))
            agree.append((minhash.signature(np.r_[a, b]) == minhash.signature(np.r_[a, c])).mean())
        assert abs(np.mean(agree) - similarity) < 0.03


def test_a_bucket_yields_no_pairs_of_one_component(spark):
    """1,500 near copies of one text: verified links grow with the copies, not with their pairs."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[: k % 120] + [f"x{k}"] + words[k % 120 + 1 :])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = minhash.materialize(minhash.signatures(docs))
    texts = signed.select("node", F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "k_text").alias("first"), F.col("n_shingles").alias("n"), "keys")
    assert minhash.links(docs, texts).count() < 40 * 1500
    assert {r.component_id for r in minhash.near_duplicates(docs).select("component_id").distinct().collect()} == {0}

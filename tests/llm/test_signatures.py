"""Near copies by similarity against brute force: every pair of shingle sets is compared, links are closed by union-find."""

import random

import numpy as np
import pytest
from meshwright.llm import signatures
from pyspark.sql import functions as F


def brute(rows):
    """Ids that stay of (id, text)."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return {i for i, r in root.items() if i == r}


def edited(rng):
    rows = [(900, None), (901, " \n"), (902, "a b c"), (903, "A  b\tc"), (904, "É b c d e f"), (905, "é b c d e f")]
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 300]))]
        for k in range(rng.randint(1, 12)):
            rows.append((g * 20 + k, " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 60)):  # a chain of edits
                words[rng.randrange(len(words))] = f"new{rng.randrange(5000)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_edited_texts(spark, block):
    rows = edited(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in signatures.keep_one(docs, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_defined_results(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base.upper()), (9, base.replace("w150", "other")), (4, "something else entirely here"), (None, base), (None, base), (None, "alone"), (11, None), (8, " "), (12, "y " * 300_000), (13, "y " * 300_001)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash")).withColumn("set", F.lit(1))
    got = signatures.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 3, 4, 8, 12]
    assert got.filter("node <> 'clash' or set <> 1").count() == 0
    assert signatures.keep_one(docs.limit(0)).count() == 0


def test_symbols_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(60):
            n = 400
            shared = int(2 * n * similarity / (1 + similarity))
            a, b, c = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, n - shared, n - shared))
            agree.append((signatures.symbols(np.r_[a, b]) == signatures.symbols(np.r_[a, c])).mean())
        assert abs(np.mean(agree) - similarity) < 0.03


def test_a_pair_that_differs_in_one_symbol_of_a_segment_meets():
    values = np.arange(signatures.SYMBOLS, dtype=np.uint64)
    for at in range(signatures.SIZE):
        other = values + np.uint64(1000)
        other[: signatures.SIZE] = values[: signatures.SIZE]
        other[at] += np.uint64(1)
        assert len(set(signatures.deletion_keys(values)) & set(signatures.deletion_keys(other))) == 1
    other[(at + 1) % signatures.SIZE] += np.uint64(1)
    assert not set(signatures.deletion_keys(values)) & set(signatures.deletion_keys(other))


def test_forest_joins_along_the_most_similar_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 60000, 64, dtype=np.uint16)
    rows = [base.copy() for _ in range(6)]
    for k, r in enumerate(rows):
        r[: 4 * k] = rng.integers(0, 60000, 4 * k, dtype=np.uint16)
    rows.append(rng.integers(0, 60000, 64, dtype=np.uint16))
    a, b = signatures.forest(np.array(rows))
    assert sorted(zip(a, b)) == [(0, k) for k in range(1, 6)]


def test_fingerprints_propose_and_similarity_decides(spark, monkeypatch):
    """Without the index of symbols, texts of fingerprints within three bits are linked, and no others."""
    from meshwright.llm import simhash

    rows = edited(random.Random(3))
    rows += [(1000 + k, " ".join(f"v{i}" for i in range(3000) if i != 700 * k)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(signatures, "candidate_edges", lambda texts, *_: texts.limit(0).selectExpr("node a", "node b"))
    words = {i: b" ".join((t or "").encode().lower().split()) for i, t in rows}
    sets = {t: signatures.shingles(t) for t in words.values()}
    root = {t: t for t in sets}
    for x in sets:
        for y in sets:
            near = (simhash.sign_bits(sets[x]) ^ simhash.sign_bits(sets[y])).bit_count() <= simhash.MAX_BITS
            if near and x != y and signatures.similar(sets[x].tobytes(), sets[y].tobytes()):
                root = {t: root[x] if r == root[y] else r for t, r in root.items()}
    want = {min(i for i in words if root[words[i]] == r) for r in root.values()}
    assert {r.doc_id for r in signatures.keep_one(docs).collect()} == want and len(want) < len(sets)

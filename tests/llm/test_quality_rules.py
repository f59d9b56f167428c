"""Quality rules: counts against plain definitions, exact bounds, and the verdict on synthetic labels."""

import math
import random
import re

import numpy as np
import pytest
from meshwright.llm import quality_rules as rules
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a\x1cb \x85 c", "é# <b>|", "a a a a a a a", "x\nx\n x\n\n\nx"]
    texts += ["".join(rng.choices(["a ", "b ", "\n", "c", "# ", "\r\n", " ", "ü "], k=rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        assert rules.counts(t)[:5] == brute(t), repr(t)
    assert rules.counts("w " * 200_000)[4] == 200_000


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.02), (50, 50, 0.5), (7, 400, 0.02), (0, 0, 0.1)])
def test_binomial_tail(k, n, p):
    assert rules.binomial_tail(k, n, p) == pytest.approx(min(1, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))))


def test_certify_stops_at_the_first_failure():
    held = np.zeros(rules.BINS + 1, dtype=np.int64)
    held[:50], held[50:100] = 1000, 5  # five good documents of a thousand at bin 50 and above, all from bin 49 down
    got = rules.certify({(0, 2): 10}, {(0, 2, 1): held}, risk=0.02)
    assert got == {(0, 2): 50}
    assert rules.certify({(0, 2): 10}, {(0, 2, 1): held}, risk=0.004) == {(0, 2): 100}
    assert rules.certify({(0, 2): 10}, {(0, 2, 1): held}, risk=0.001) == {}
    assert rules.certify({(0, 2): 10}, {(0, 2, 1): np.zeros(rules.BINS + 1, dtype=np.int64)}) == {}


def documents(n, rng):
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(rng.choices("abcdefghij", k=5)) + ("***" if bad else "") for _ in range(60)]
        yield i, " ".join(words), 0 if bad else 1


def test_verdict(spark):
    rng = random.Random(8)
    rows = list(documents(3000, rng))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, rows[1][1], "x"), (1, rows[1][1], "x"), (9999, None, "x")], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(i, q, 0) for i, _, q in rows if not i % 2] + [(7, 0, 1), (None, 1, 0), (11, None, 0)], "doc_id bigint, quality int, toxic int")
    got = rules.judge(docs, labels).collect()
    assert len(got) == 3003
    quality = {i: q for i, _, q in rows}
    assert all(r.kept == (quality[r.doc_id] == 1) for r in got if r.doc_id in quality)
    assert [r.kept for r in got if r.doc_id == 9999] == [False] and [r.kept for r in got if r.doc_id is None] == [True]
    docs = docs.withColumn("k_text", F.lit("mine"))
    kept = rules.keep_good(docs, labels)
    assert kept.filter("k_text <> 'mine' or kept <> 'clash'").count() == 2
    assert kept.columns == docs.columns and kept.count() == 2400 + 2
    none = rules.judge(docs.withColumn("n_words", F.lit(0)), labels.limit(0)).collect()
    assert sum(not r.kept for r in none) == 1  # without labels only the base rules decide
    assert rules.judge(docs.limit(0), labels).count() == 0

"""Importance resampling against plain Python: every n-gram joined as a text, its CRC by zlib, places by sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from meshwright.llm import resampling
from pyspark.sql import functions as F


def features(text, max_n):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_n, buckets, min_words, share, seed=2024):
    """{(doc_id, text): (n_words, n_features, weight, score)} and the ranked ones in order."""
    place = lambda g: zlib.crc32(g) % buckets
    s, t = (Counter(place(g) for x in texts for g in features(x, max_n)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = {}
    for i, text in docs:
        words, grams = features(text, max_n)
        weight = sum(gain(place(g)) for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i, text] = len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
    able = sorted((k for k in out if out[k][0] >= min_words), key=lambda k: (-out[k][3], k[0] is None, k[0] or 0))
    return out, able[: share[0] * len(able) // share[1]]


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_crcs_of_ngrams_by_algebra(max_n):
    rng = random.Random(max_n)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 2, 7, 300, 70_000]))) for _ in range(12)] + [b"\xc3\xa9t\xc3\xa9"]
    crcs, lengths = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for n, got in enumerate(resampling.ngram_crcs(crcs, lengths, max_n), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_pieces_of_a_long_text_hold_each_feature_once(monkeypatch, max_n):
    text = " ".join(f"w{i % 37}" for i in range(4000)).encode() + b"x" * 3000 + b" tail -- end"
    whole = Counter(zlib.crc32(g) % 1000 for g in features(text.decode(), max_n)[1])
    monkeypatch.setattr(resampling, "PIECE", 100)
    found = list(resampling.text_buckets(text, max_n, 1000))
    assert len(found) > 100 and sum(n for n, _ in found) == len(features(text.decode(), 1)[0])
    assert Counter(np.concatenate([b for _, b in found]).tolist()) == whole


@pytest.mark.parametrize("max_n", [1, 3])
def test_whole_result(spark, max_n, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(("Ab", "c-d", "Éa", "x", "9z", "K")) + str(rng.randrange(60)) for _ in range(rng.choice([0, 3, 25, 400])))) for i in range(90)]
    docs += [(90, None), (91, ""), (None, docs[4][1] + " more"), (93, "--- !!"), (3, "again " * 30)]
    target = [f"ab{i} c {i}" for i in range(60)] + [None, ""]
    monkeypatch.setattr(resampling, "PART_ROWS", 10)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"rank": F.lit("clash"), "part": F.lit(1), "_row": F.lit(2), "weight": F.lit(0.5)})
    share = (30, 100)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, buckets=97, min_words=20, share=share)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want, drawn = brute(docs, target, max_n, 97, 20, share)
    place = {k: n for n, k in enumerate(drawn, 1)}
    rows = sorted(((k[0], *v, place.get(k)) for k, v in want.items()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == rows and len(drawn) > 10


def test_ties_and_repeated_rows(spark):
    """Rows of one id have the same noise, so equal texts tie; places are still 1, 2, 3 .. without gaps."""
    docs = spark.createDataFrame([(7, "a b c d")] * 50 + [(8, "a b c d"), (None, "a b c d")] * 5, "doc_id bigint, text string")
    got = resampling.resample(docs, docs.limit(1), min_words=4, share=(100, 100)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 61))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in got] == sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    got = resampling.resample(docs, docs.limit(0), share=(1, 1)).collect()
    want, drawn = brute([(1, "a " * 30)], [], 1, 10_000, 20, (1, 1))
    assert [tuple(r) for r in got] == [(1, *want[drawn[0]], 1)]
    assert resampling.resample(docs.limit(0), docs).collect() == []
    assert resampling.resample(docs.limit(0), docs.limit(0)).collect() == []

"""The three trained models: held-out accuracy on the small tables, edge cases, and their parts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from meshwright.llm import common, language, queries, quality_model, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def accuracy(got, truth, label, predicted="predicted"):
    rows = got.join(truth.select("doc_id", label), "doc_id").filter("held_out").select(label, predicted).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_held_out(spark, small):
    got = queries.op1_quality_classifier(spark, SF)
    assert accuracy(got, small["labels"], "quality") > 0.95
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0 and got.count() == 1000


def test_language_held_out(spark, small):
    got = queries.op5_language_id(spark, SF)
    assert accuracy(got, small["documents"], "lang", "lang_pred") > 0.97


def test_every_one_of_many_languages_is_learned(spark):
    # Two large languages and 300 small ones, one of which is a single row many times over.
    rows = [(i, f"text {i} of the large", f"big{i % 2}") for i in range(3000)]
    rows += [(10_000 + i, f"zq{i % 299} word{i % 299} {i}", f"small{i % 299:03}") for i in range(299 * 4)]
    rows += [(50_000, "over and over", "same")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    every = {r[2] for r in rows}
    picked = language.first_of_each(docs, 3).groupBy("lang").count().collect()
    assert {r.lang for r in picked} == every and {r["count"] for r in picked if r.lang != "same"} == {3}
    assert [r["count"] for r in picked if r.lang == "same"] == [1]
    assert set(language.train(docs, 10, held_out=F.lit(False)).languages) == every


def test_labelled_sample_has_a_row_an_id(spark):
    rows = [(1, f"copy {i % 7}") for i in range(2000)] + [(2, "two"), (3, None), (None, "x"), (4, "four")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(4, 1)], "doc_id bigint, quality int")
    got = common.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0)]
    again = common.labelled_sample(docs.repartition(3), labels, "quality", F.lit(True), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_toxicity_held_out(spark, small):
    got = queries.op6_toxicity(spark, SF)
    assert accuracy(got, small["labels"], "toxic") > 0.9
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0 and got.count() == 1000


def odd_tables(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "x" * 300_000, "de"), (6, "½ ² ①", "en"), (7, "ª ː", "en"), (8, "Ⅷ ٣", None), (None, "some words here", "en"), (5, "a b", "en"), (5, "a b", "en")]
    docs = spark.createDataFrame([(*r, 9, "clash") for r in rows], "doc_id bigint, text string, lang string, score int, label string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)] + [(2, 1, 1), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_odd_rows(spark):
    docs, labels = odd_tables(spark)
    for table in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        for score in (quality_model.score_quality, toxicity.score_toxicity):
            got = score(docs, table).collect()
            assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id == 5}) == 1
            assert [r.held_out for r in got if r.doc_id is None] == [False]
            assert score(docs.limit(0), table).count() == 0
    langs = language.identify(docs).collect()
    assert {r.lang_pred for r in langs if r.doc_id in (1, 2, 3, 6, 8)} == {"und"} and {r.lang_pred for r in langs if r.doc_id == 4} <= {"en", "de"}
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def brute_kernel(word, landmark):
    """Sum over common subsequences, gaps weighed by what they skip."""
    code_w, code_l = toxicity._matrix([word])[0], toxicity._matrix([landmark])[0]
    gap = lambda c: toxicity.OTHER_GAP if c == toxicity.OTHER else toxicity.LETTER_GAP
    total = 0.0
    for a in itertools.combinations(range(len(code_w)), toxicity.ORDER):
        for b in itertools.combinations(range(len(code_l)), toxicity.ORDER):
            if all(code_w[i] == code_l[j] != toxicity.OTHER for i, j in zip(a, b)):
                skipped = [code_w[i] for i in range(a[0], a[-1]) if i not in a]
                total += np.prod([gap(c) for c in skipped]) * toxicity.LETTER_GAP ** sum(j not in b for j in range(b[0], b[-1]))
    return total


@pytest.mark.parametrize("word,landmark", [("idiot", "idiot"), ("id-iot", "idiot"), ("idxiot", "idiot"), ("i.d.i.o.t", "idiot"), ("thrash", "trash"), ("chónñ", "chón"), ("aaaaaa", "aaaa"), ("other", "words")])
def test_string_kernel(word, landmark):
    w, l = word.encode(), landmark.encode()
    got = toxicity.raw_kernel(toxicity._matrix([w]), toxicity._matrix([l]))[0]
    assert got == pytest.approx(brute_kernel(w, l))
    lcs = toxicity.common_subsequence(toxicity._matrix([w]), toxicity._matrix([l]))[0, 0]
    assert (lcs >= toxicity.ORDER) == (got > 0)


def test_gapped_insults_score_like_plain_ones():
    marks = toxicity.Landmarks([b"\x02idiot", b"\x02worthless"], 2)
    for text in (b"an idiot.", b"an i d i o t here", b"an id-iot", b"I.D.I.O.T", b"so w*o*r*t*h*l*e*s*s", b"x" * 90 + b"idiot\nidiotic"):
        assert max(s.max() for s in toxicity._sentences(marks, [text])) > 0.9, text
    clean = next(toxicity._sentences(marks, [b"the editor said it was worth less than a lot\n\nid\niot"]))
    assert clean.max(initial=0) < 0.6


def written(word, rng):
    """{variant: ways to write an insult}."""
    inside = range(1, len(word))
    return {
        "plain": [word, word.upper(), word + "s"],
        "sign": [word[:i] + c + word[i:] for i in inside for c in "-*._0"],
        "letter": [word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i:] for i in inside for _ in range(3)],
        "repeated letter": [word[:i] + word[i - 1] * k + word[i:] for i in range(1, len(word) + 1) for k in (1, 2, 5)],
        "blank": [word[:i] + " " + word[i:] for i in inside],
        "blanks": [" ".join(word)],
        "dots": [".".join(word), "-".join(word)],
    }


def test_every_landmark_in_every_variant(spark):
    """The model of the larger table: each insult it has learned, with something inserted at each place; and clean documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model, _ = toxicity.train(docs.select("doc_id", "text"), labels)
    marks, rng = model.landmarks, random.Random(1)
    assert marks.toxic >= 8
    tried, found = Counter(), Counter()
    for w in marks.words[: marks.toxic]:
        for kind, ways in written(w.removeprefix(b"\x02").decode(), rng).items():
            for sentences in toxicity._sentences(marks, [f"They said it was such a {x}, and left.".encode() for x in ways]):
                tried[kind] += 1
                found[kind] += model.probability(model.margin(sentences)) >= 0.5
    assert all(found[k] >= 0.9 * n for k, n in tried.items()), (found, tried)
    clean = [t.encode() for t, in docs.join(labels.filter("toxic = 0"), "doc_id").select("text").collect()]
    flagged = sum(model.probability(model.margin(s)) >= 0.5 for s in toxicity._sentences(marks, clean))
    assert flagged <= 0.001 * len(clean)


def test_score_by_its_parts(spark, small):
    """Every score of a small table, from the model's parts by a plainer path."""
    docs = small["documents"].select("doc_id", "text")
    model, share = toxicity.train(docs, small["labels"])
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, small["labels"]).collect()}
    for i, text in docs.collect():
        if model is None:
            assert got[i] == share
            continue
        best, sentence = model.b, np.zeros(len(model.landmarks.words))
        table = toxicity.Table(model.landmarks)
        words = toxicity.split_words(text.encode())
        table.add(set(words))
        spelled = table._spelled(words, [k for k, w in enumerate(words) if table.codes[w] & 2])
        table.add(set(spelled.values()))
        for k, w in enumerate(words):
            sentence = np.maximum(sentence, table.rows[table.codes[spelled.get(k, w)] >> 2])
            if table.codes[w] & 1 or k == len(words) - 1:
                best = max(best, float(sentence @ model.w + model.b) if sentence.any() else best)
                sentence = np.zeros_like(sentence)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-model.slope * np.clip(best, -1, 1))), abs=1e-5)


@pytest.mark.parametrize("word,landmark,near", [("idxiot", "idiot", True), ("xidiot", "idiot", False), ("idiotx", "idiot", False), ("idxyiot", "idiot", False), ("idiiiiot", "idiot", True), ("idxiots", "idiot", True), ("idxiotically", "idiot", False), ("id-iot", "idiot", False)])
def test_one_letter_more(word, landmark, near):
    assert toxicity.one_letter_more(b"\x02" + word.encode(), b"\x02" + landmark.encode()) == near


def test_n_grams_of_slices(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.choice(np.frombuffer(b"abc d", dtype=np.uint8), 500))
    whole = {(w, int(p), int(h)) for w, places, hashes in toxicity._grams(text) for p, h in zip(places, hashes)}
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 7)
    assert {(w, int(p), int(h)) for w, places, hashes in toxicity._grams(text) for p, h in zip(places, hashes)} == whole and whole


def test_random_indexing_sums_neighbours():
    index = quality_model.index_vectors(quality_model.SHAPE_BITS, 2)
    ids = np.array([3, 1, 3, 3, 2])
    sums = np.zeros_like(index)
    quality_model.add_contexts(sums, index, ids)
    for b in (1, 2, 3):
        want = sum(index[ids[j]] for i in range(5) if ids[i] == b for j in range(max(0, i - 2), min(5, i + 3)) if j != i)
        assert (sums[b] == want).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 50])
def test_random_indexing_in_slices(monkeypatch, n):
    index = quality_model.index_vectors(quality_model.SHAPE_BITS, 2)
    ids = np.random.default_rng(n).integers(0, 6, n)
    want = np.zeros_like(index)
    for i in range(n):
        for j in range(max(0, i - 2), min(n, i + 3)):
            if j != i:
                want[ids[i]] += index[ids[j]]
    for size in (1, 2, 3, 4, 1 << 15):
        monkeypatch.setattr(quality_model, "SLICE_WORDS", size)
        sums = np.zeros_like(index)
        quality_model.add_contexts(sums, index, ids)
        assert (sums == want).all(), size


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    score = quality_model.Network().fit(x, y).score(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (score >= low) & (score < low + 0.2)
        assert abs(y[part].mean() - score[part].mean()) < 0.08


def test_language_scores_by_plain_python(spark):
    """Every prediction over a whole table, from the model's numbers by loops over letters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for i, text, _ in docs.collect():
        raw = [c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode()]
        counts = Counter(((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 20 for a, b, c in zip(raw, raw[1:], raw[2:]))
        x = {b: math.log1p(n) * float(model.idf[b]) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[b]) for b, v in x.items()) / norm for c in model.centers]
        best = max(cosines)
        assert got[i].score == pytest.approx(min(1, max(0, best)), abs=1e-4)
        assert got[i].lang_pred in {model.languages[model.owner[k]] for k, c in enumerate(cosines) if c > best - 1e-4}


def test_quality_scores_by_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    words, shapes, network = quality_model.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, labels).collect()}
    dim = quality_model.DIM
    for i, text in docs.collect():
        pieces = text.encode().split()
        features = [0.0] * (2 * dim + 2)
        buckets = [zlib.crc32(w.lower()) >> (32 - quality_model.WORD_BITS) for w in pieces]
        for w, b in zip(pieces, buckets):
            s = zlib.crc32(quality_model.shape(w)) >> (32 - quality_model.SHAPE_BITS)
            for k in range(dim):
                features[k] += float(words[b][k]) / len(pieces)
                features[dim + k] += float(shapes[s][k]) / len(pieces)
        if pieces:
            features[2 * dim] = sum(a == b for a, b in zip(buckets, buckets[1:])) / max(1, len(pieces) - 1)
            features[2 * dim + 1] = math.log1p(len(pieces)) / 10
        z = [(x - m) / s for x, m, s in zip(features, network.mean, network.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, network.p[0][:, h])) + network.p[1][h]) for h in range(quality_model.HIDDEN)]
        logit = (sum(a * w for a, w in zip(hidden, network.p[2])) + network.p[3][0]) / network.temperature
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)

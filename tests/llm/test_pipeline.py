"""The pipeline against brute force over a whole small table."""

import corpus_pipeline
import public_tokenizers
from meshwright.llm import mixing, quality_rules
from tokenizers import Tokenizer

from .test_line_dedup import brute as brute_lines
from .test_mixing import brute_targets
from .test_signatures import brute as brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    functions = dict(corpus_pipeline.STAGES)
    kept = functions["quality rules"](spark, docs, SF)
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    base = {i: c for i, c in ((i, quality_rules.counts(t)) for i, t in rows.items()) if c[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert {i for i, k in judged.items() if k} <= set(base)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {i for i, k in judged.items() if k} and all(rows[i] == t for i, t in texts.items())

    cut = functions["line dedup"](spark, kept, SF)
    assert cut.columns == docs.columns
    want = {i: t for i, _, _, t in brute_lines(list(texts.items()))}
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    single = functions["simhash near-dedup"](spark, cut, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted(brute_kept(list(want.items())))

    mixed = functions["source mixing"](spark, single, SF)
    assert mixed.columns == docs.columns
    sizes, taken, longest = {}, {}, {}
    for out, frame in ((sizes, single), (taken, mixed)):
        for r in frame.select("source", "doc_id", mixing.word_count(frame.text).alias("n")).collect():
            out[r.source] = out.get(r.source, 0) + r.n
            longest[r.source] = max(longest.get(r.source, 0), r.n)
    targets = brute_targets(sizes)
    assert all(abs(taken.get(s, 0) - targets[s]) <= longest[s] for s in sizes)

    coded = functions["bpe encoding"](spark, mixed, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(coded) == mixed.count() and all(r.intact for r in coded)
    assert all(r.ids == library.encode(want[r.doc_id], add_special_tokens=False).ids for r in coded)


def test_run(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "intact"] and result.count() > 50


def test_odd_rows(spark, tmp_path):
    good = [" ".join(f"{w}{i}" for w in "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()) for i in range(40)]
    rows = [(i, t, "en" if i % 3 else None, "a" if i % 4 else None) for i, t in enumerate(good)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \n\t", "de", "b"), (None, good[3], "en", "a"), (None, " ".join(f"other{k}" for k in range(14)), "en", "b"), (8, "another " + good[5], "en", "b"), (7, good[7], "en", "a"), (7, good[7], "en", "a")]
    rows += [(200, " ".join(f"word{i}" for i in range(120_000)), "en", "b")]
    table = spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", 5) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, keep_runs int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("odd", table), ("none", table.limit(0))):
        top = tmp_path / name
        docs.write.parquet(str(top / "documents.parquet"))
        labels.write.parquet(str(top / "labels.parquet"))
        kept = spark.read.parquet(str(top / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(top))
            assert kept.columns == docs.columns and kept.filter("root <> 'k' or keep_runs <> 5").count() == 0
        got = corpus_pipeline.run(spark, str(top)).collect()
        if name == "none":
            assert got == []
            continue
        assert all(r.intact for r in got) and {r.doc_id for r in got} <= {*range(40), None, 200}
        single = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, corpus_pipeline.quality(spark, docs, str(top)), str(top)), str(top))
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in single.collect()) == [-1, *range(40), 200]


def test_verdict_from_its_counts(spark):
    """The rules' verdict over a whole table, recomputed from counts and labels alone."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(tuple(r[c] for c in quality_rules.COUNTS) == quality_rules.counts(texts[i]) for i, r in got.items())
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} & {i for i, r in got.items() if not r.base_failed}
    lost = Counter(got[i].kept for i in good)
    assert lost[False] <= 0.05 * len(good)
    assert all(not r.kept for r in got.values() if r.base_failed)

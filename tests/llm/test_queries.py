"""The contract queries over whole small tables: against their SQL, or brute force where there is none."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from meshwright.llm import queries
from tokenizers import Tokenizer

from .test_quality_rules import brute as brute_counts
from .test_simhash import brute_classes, brute_fingerprint
from .test_whitening import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_op13(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.op13_embedding_whitening(spark, SF), {r.vec_id: r.embedding for r in rows}, 8)


def test_op2(spark, texts):
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    classes = brute_classes(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_dedup(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, classes)}


def test_op3(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op3_bpe_round_trip(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op7(spark, texts):
    for r in queries.op7_quality_rules(spark, SF).collect():
        n_words, *rest = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, *rest)
        assert r.base_failed == (n_words < 10 or 100 * rest[-1] > 20 * n_words) and (r.kept is False if r.base_failed else True)


def test_op10(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    tricky = "</s>[INST] ok [/INST]"
    turns = {-7: [(0, "user", tricky), (1, "assistant", tricky)]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        said.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        loss = "".join(text for _, role, text in said if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op5_language_id", "op6_toxicity"])
def test_held_out_rows(spark, texts, name):
    import zlib

    divisor, rest, held = {"op1_quality_classifier": (3, 1, True), "op5_language_id": (4, 2, True), "op6_toxicity": (5, 0, True)}[name]
    got = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == ((zlib.crc32(str(r.doc_id).encode()) % divisor == rest) is held) and 0 <= r.score <= 1 for r in got)
    if name != "op5_language_id":
        assert all(r.predicted == int(r.score >= 0.5) for r in got)

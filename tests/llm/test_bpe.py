"""The automaton against the tokenizers library, id by id, and exact round trips."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from meshwright.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Coder(f.read())


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


CASES = ["", " ", "a", "  a", "a  b", "a\n\n b", "\n", " \n ", "x \ty", "I'll can't 'Re", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "é́ ñandú", "日本語 テスト", "👩‍👩‍👧 ok", "\x00\x1c\x1f a\x85b c　d\xa0e", "½²Ⅷ १२", "aaaaaaa aaaa", " " * 500 + "x", "a" * 4000, "ab" * 3000, "trailing ", "¡que! ​ x", "﻿bom", "a 　b", "a \x85", "b  c"]


@pytest.mark.parametrize("text", CASES)
def test_cases(coder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(coder.encode(text)) == want
    assert coder.decode(coder.encode(text)) == library.decode(want, skip_special_tokens=False) == text


def test_random_texts(coder, library):
    rng = random.Random(5)
    alphabets = ["ab", "abcde ", "theranioust  ", "aeé ñ\n\t'sdl.,!0123", "".join(map(chr, range(32, 1200)))]
    for i in range(4000):
        text = "".join(rng.choices(alphabets[i % 5], k=rng.randint(1, 60)))
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character(coder, library):
    odd = []
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000 and (ord(c) < 0x20000 or ord(c) % 97 == 0):
            text = f"a{c}b {c}"
            if ids(coder.encode(text)) != library.encode(text, add_special_tokens=False).ids:
                odd.append(hex(ord(c)))
    assert odd == []


def test_frames(spark, library):
    rows = [(1, "Hello  world\n", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "naïve <|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    coded = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in coded.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    for r in bpe.round_trip(docs, PATH).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_transitions_are_bounded_within_a_word(coder, library, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (1, 30, 64, 65, 30_000)]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    for limit in (1, 7, 1000):
        monkeypatch.setattr(bpe, "TRANSITION_LIMIT", limit)
        coder.automaton._clear()
        for w, ids_of_w in zip(words, want):
            assert list(coder.automaton.encode(w.encode())) == ids_of_w
            assert len(coder.automaton.table) <= limit and len(coder.automaton.places) <= limit + 2
    coder.automaton._clear()

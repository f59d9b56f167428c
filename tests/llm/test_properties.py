"""Properties over arbitrary texts."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from meshwright.llm import bpe, chat, quality_rules, simhash
from tokenizers import Tokenizer

from .test_quality_rules import brute as brute_counts
from .test_simhash import brute_fingerprint

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    _JSON = f.read()
CODER, FORMATTER, LIBRARY = bpe.Coder(_JSON), chat.Formatter(_JSON), Tokenizer.from_file(PATH)
TEXT = st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'the.")), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library_and_decodes(text):
    packed = CODER.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert packed == b"".join(i.to_bytes(4, "little") for i in want) and CODER.decode(packed) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "other"]), st.one_of(TEXT, st.sampled_from(chat.CONTROLS))), max_size=5))
def test_chat_round_trip(turns):
    formatted, _, offsets, mask = FORMATTER.format(turns)
    assert FORMATTER.template.parse(formatted) == turns
    assert FORMATTER.loss_text(formatted, offsets, mask) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_and_fingerprints(text):
    assert quality_rules.counts(text)[:5] == brute_counts(text)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)

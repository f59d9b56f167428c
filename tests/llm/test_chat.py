"""Chat formatting: exact round trips, masks that hold the assistant texts and nothing else."""

import hashlib
import random

import public_tokenizers
import pytest
from meshwright.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = chat.CONTROLS + ["\\", "\\\\", "<", "[", "/", "INST]", "<\\s>", "<|endoftext|>", " ", "\n", "é", "日本", "👩‍👧", "ok", "'s", "a  b", ""]


@pytest.fixture(scope="module")
def formatter():
    with open(PATH, encoding="utf-8") as f:
        return chat.Formatter(f.read())


def test_round_trip_and_mask(formatter):
    rng = random.Random(3)
    for _ in range(1500):
        turns = [
            (rng.choice(["user", "assistant", "system", "tool", "", "[TEXT]", "a\\"]), "".join(rng.choices(PIECES, k=rng.randint(0, 7))))
            for _ in range(rng.randint(1, 6))
        ]
        formatted, ids, offsets, mask = formatter.format(turns)
        assert formatter.template.parse(formatted) == turns
        assert formatter.loss_text(formatted, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
        assert len(ids) == len(mask)


def test_spans_equal_the_library(formatter):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices([*PIECES, "ü", "Ⅷ½", "\x00", "漢字かな", "🏳️‍🌈x"], k=rng.randint(0, 12)))
        coded = formatter.tokenizer.encode(text, add_special_tokens=False)
        assert chat.char_spans(text, formatter.lengths[coded.ids]).tolist() == [list(x) for x in coded.offsets]


def test_frames(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (1, 1, "assistant", "B"), (2, 0, None, None), (None, 0, "assistant", "</s>[INST] ok"), (3, None, "user", "x" * 50000), (3, 2, "assistant", "")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_digests(frame, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha("user\nA\nassistant\nB\nassistant\nB\n"), 2)
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (1, sha("\n\n"), sha(""))
    assert (got[None].loss_sha256, got[None].loss_chars) == (sha("</s>[INST] ok"), 13)
    assert got[3].formatted_chars == 50000 + len("[INST][/INST]<s></s>")
    full = {r.conv_id: r for r in chat.format_conversations(frame, PATH).collect()}
    assert full[1].formatted == "[INST]A[/INST]<s>B</s><s>B</s>" and len(full[1].ids) == len(full[1].loss_mask) == len(full[1].spans)
    assert chat.format_digests(frame.limit(0), PATH).count() == 0

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole through a template that marks turns with control strings, encoded
once with character offsets (a byte-level token spans as many bytes as its label has), and a token is under the loss mask if its span lies within the text of
an assistant turn, which binary search over the sorted turn spans tells. Control strings are single
tokens of their own, so no token reaches over a turn's border. Inside texts they are escaped: a
backslash goes behind their first character, and backslashes are doubled.

Turns are dealt by conversation and sorted by turn in the shuffle; a conversation is then read as a
stream, so memory holds one conversation at a time.

Defined results: null texts and null roles are read as empty; a null conv_id is a conversation of its
own; null turns come first; equal turns are ordered by role, then text; repeated rows are turns of
their own. A role other than user, assistant and system is kept by name, outside the mask. An empty
table gives an empty table. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import check_settings
from .common import bound_batches

#: Opening and closing marks by role; NAMED marks any other role, whose name stands before TEXT.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, TEXT, END = "[ROLE]", "[TEXT]", "[/ROLE]"
#: Conversations and characters that are formatted together.
GROUP_ROWS, GROUP_CHARS = 256, 1 << 20
CONTROLS = [m for pair in MARKS.values() for m in pair] + [NAMED, TEXT, END]


class Template:
    """Renders turns to a formatted text and reads them back. extra: further strings to escape in texts."""

    def __init__(self, extra: tuple[str, ...] = ()):
        longest_first = sorted({*CONTROLS, *extra}, key=len, reverse=True)
        self._special = re.compile(r"\\|" + "|".join(map(re.escape, longest_first)))
        self._escaped = re.compile(r"\\(\\?)")
        opening = "|".join(re.escape(m[0]) for m in MARKS.values())
        self._turn = re.compile(f"(?:({opening})|{re.escape(NAMED)})")
        self._role = {pair[0]: role for role, pair in MARKS.items()}

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
        """The formatted text, and (start, end, is assistant) of each turn's text in it, in order."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            before, after = MARKS.get(role, (NAMED + self.escape(role) + TEXT, END))
            body = self.escape(text)
            parts += [before, body, after]
            spans.append((at + len(before), at + len(before) + len(body), role == "assistant"))
            at += len(before) + len(body) + len(after)
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn begins at character {at}")
            if m[1]:
                role = self._role[m[1]]
                end = formatted.index(MARKS[role][1], m.end())
                turns.append((role, self.unescape(formatted[m.end() : end])))
                at = end + len(MARKS[role][1])
            else:
                middle = formatted.index(TEXT, m.end())
                end = formatted.index(END, middle)
                turns.append((self.unescape(formatted[m.end() : middle]), self.unescape(formatted[middle + len(TEXT) : end])))
                at = end + len(END)
        return turns


def align(token_spans: np.ndarray, turn_spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """For each token (start, end): whether it lies within the text of an assistant turn."""
    wanted = np.array([s[:2] for s in turn_spans if s[2] and s[1] > s[0]], dtype=np.int64).reshape(-1, 2)
    if not len(wanted) or not len(token_spans):
        return np.zeros(len(token_spans), dtype=bool)
    at = np.searchsorted(wanted[:, 0], token_spans[:, 0], side="right") - 1
    return (at >= 0) & (token_spans[:, 1] <= wanted[at, 1]) & (token_spans[:, 0] < token_spans[:, 1])


def masked_runs(token_spans: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character runs that the masked tokens cover. Tokens that share a character count it once."""
    spans = token_spans[mask]
    if not len(spans):
        return []
    reached = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reached[:-1]])
    return list(zip(spans[first, 0].tolist(), reached[np.r_[first[1:] - 1, len(spans) - 1]].tolist()))


def char_spans(text: str, lengths: np.ndarray) -> np.ndarray:
    """(start, end) in characters of tokens that spell the text with so many bytes each; a token that has part of a character spans it."""
    ends = np.cumsum(lengths)
    spans = np.stack([ends - lengths, ends], axis=1)
    if len(spans) and not text.isascii():
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        spans = np.stack([of_byte[spans[:, 0]], of_byte[spans[:, 1] - 1] + 1], axis=1)
    return spans


class Formatter:
    def __init__(self, tokenizer_json: str):
        from tokenizers import AddedToken, Tokenizer

        check_settings(json.loads(tokenizer_json))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.template = Template(known)
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # a byte is one character of the vocabulary's alphabet
            self.lengths[i] = len(added[i].encode()) if i in added else len(token)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray, np.ndarray]:
        """(formatted text, token ids, token spans, loss mask)."""
        return next(self.format_all([turns]))

    def format_all(self, conversations: list[list[tuple[str, str]]]) -> Iterator[tuple[str, list[int], np.ndarray, np.ndarray]]:
        """format() of each conversation, encoded together."""
        rendered = list(map(self.template.render, conversations))
        coded = self.tokenizer.encode_batch_fast([text for text, _ in rendered], add_special_tokens=False)
        for (text, spans), c in zip(rendered, coded):
            offsets = char_spans(text, self.lengths[c.ids])
            yield text, c.ids, offsets, align(offsets, spans)

    def loss_text(self, formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
        return "".join(self.template.unescape(formatted[a:b]) for a, b in masked_runs(offsets, mask))


_formatters: dict[str, Formatter] = {}


def _formatter(source) -> Formatter:
    key = hashlib.sha256(source.value.encode()).hexdigest()
    if key not in _formatters:
        _formatters[key] = Formatter(source.value)
    return _formatters[key]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    rows = (r for b in batches for r in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()))
    for conv, turns in groupby(rows, key=itemgetter(0)):
        yield conv, [(role or "", text or "") for _, role, text in turns]


def _groups(conversations: Iterator[tuple[int | None, list[tuple[str, str]]]]) -> Iterator[list[tuple[int | None, list[tuple[str, str]]]]]:
    """Conversations in groups of up to GROUP_ROWS rows and about GROUP_CHARS characters."""
    group, chars = [], 0
    for conv, turns in conversations:
        group.append((conv, turns))
        chars += sum(len(text) for _, text in turns)
        if len(group) >= GROUP_ROWS or chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _over(conversations: DataFrame, tokenizer_path: str, make, schema: str) -> DataFrame:
    """make(formatter, conv_id, formatted conversation) -> a row of schema, for each conversation."""
    with open(tokenizer_path, encoding="utf-8") as f:  # of a fixed size: a model, not data
        source = conversations.sparkSession.sparkContext.broadcast(f.read())
    types = conversations.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = _formatter(source)
        for group in _groups(_conversations(batches)):
            rows = [make(formatter, conv, done) for (conv, _), done in zip(group, formatter.format_all([turns for _, turns in group]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    dealt = bound_batches(conversations).select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, types)


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, formatted, ids, loss_mask, spans): one row per conversation; loss_mask has a 0 or 1 per token."""

    def make(formatter: Formatter, conv, done):
        formatted, ids, offsets, mask = done
        return conv, formatted, ids, mask.astype(np.int8).tolist(), [{"start": a, "end": b} for a, b in offsets.tolist()]

    return _over(conversations, tokenizer_path, make, "conv_id bigint, formatted string, ids array<int>, loss_mask array<tinyint>, spans array<struct<start:int,end:int>>")


def format_digests(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """What the formatted conversations hold, read back from them: turns through the template, loss text through the mask."""

    def make(formatter: Formatter, conv, done):
        formatted, _, offsets, mask = done
        back = formatter.template.parse(formatted)
        loss = formatter.loss_text(formatted, offsets, mask)
        said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in back).encode())
        return conv, len(back), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)

    return _over(conversations, tokenizer_path, make, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

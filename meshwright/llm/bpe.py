"""Byte-level BPE as a deterministic automaton over token labels.

The automaton starts with one state whose arcs are the 256 bytes. Each merge u + v -> w, in order,
applies a gadget: the state behind u is copied without its v arc (u then v is no longer a correct
tokenization), and w arcs are added wherever u arcs leave, leading to where v then led. All arcs of
one label lead to one state, so states are named by labels. A copy keeps a reference to the state
that it was copied from and the time of the copy, and an added arc one to the arc it stands for;
the automaton of 50,000 merges is a few arrays.

A word has exactly one path through the automaton that spells its bytes, and so has each of its
prefixes. Read byte by byte the automaton is determinized: a state of that is the set of places that a
prefix can have reached, one behind a whole arc and the others inside longer arcs. Its transitions by
(state, byte) are computed when a text first needs them and then kept in a table, and each state
knows the last label of its prefix's path. So a word is encoded by one pass through the table and read
off from its end; nothing is tried and taken back. Decoding emits the labels of the arcs.

Defined results: a null text is read as empty, has no ids and decodes to the empty text. Texts of any
length are coded whole, a piece at a time; within a word of any length the table of transitions starts
anew when it is full, from the state that was reached. Other columns pass through untouched. A vocabulary file
whose settings differ from those implemented here is refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: How byte-level vocabularies pre-split text (fixed value: the vocabulary was built with it).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece table, and the longest piece kept in it; transitions kept.
TABLE_LIMIT, PIECE_LIMIT, TRANSITION_LIMIT = 120_000, 64, 500_000
#: The settings of a vocabulary file that are implemented; others are refused.
SETTINGS = {
    "normalizer": None, "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_settings(spec: dict) -> None:
    """Raise ValueError if a vocabulary file asks for anything that isn't implemented."""
    for part, wanted in SETTINGS.items():
        given = spec.get(part)
        differ = given != wanted if wanted is None else [k for k, v in wanted.items() if (given or {}).get(k, v) != v]
        if differ or (wanted is not None and given is None):
            raise ValueError(f"unsupported {part}: {given if part != 'model' else differ}")
    for token in spec.get("added_tokens", []):
        if any(token.get(k, v) != v for k, v in ADDED.items()):
            raise ValueError(f"unsupported flags of the added token {token['content']!r}")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: themselves where printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Labels, states and transitions compiled from (token strings -> id) and merges in order."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        alphabet = byte_alphabet()
        label = {t: bytes(map(alphabet.__getitem__, t)) for t in vocab if all(c in alphabet for c in t)}
        self.ids = {label[t]: i for t, i in vocab.items() if t in label}
        size = max(vocab.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.labels[i] = b
        #: When a label's arc came to be, the arc it stands for, and the state its state was copied from.
        self.born, self.arc_of, self.state_of = [-1] * size, [-1] * size, [-1] * size
        #: (label, arc) -> when the state behind the label lost the arc.
        self.lost: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        # The trie of labels: child by (node, byte), the label that ends at a node, whether it goes on.
        self.child: dict[int, int] = {}
        self.ends, self.goes_on = [-1], [False]
        for b, i in self.ids.items():
            at = 0
            for byte in b:
                key = at << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.goes_on[at] = True
                    self.ends.append(-1)
                    self.goes_on.append(False)
                at = self.child[key]
            self.ends[at] = i
        self.lengths = list(map(len, self.labels))
        self._clear()

    def _clear(self) -> None:
        """States as tuples of places (label behind which an arc began + 1, node inside it), 0 for no label: the start."""
        self.places: list[tuple[int, ...]] = [(0,)]
        self.numbers: dict[tuple[int, ...], int] = {(0,): 0}
        #: The label of the whole arc that leads to a state, and transitions by (state, byte).
        self.last: list[int] = [-1]
        self.table: dict[int, int] = {}

    def _carry(self, state: int) -> int:
        """Forget all states and transitions but this state; returns its new number."""
        places, label = self.places[state], self.last[state]
        self._clear()
        if places not in self.numbers:
            self.numbers[places] = len(self.places)
            self.places.append(places)
            self.last.append(label)
        return self.numbers[places]

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.lost[u, v] = time
        self.born[w], self.arc_of[w], self.state_of[w] = time, u, v

    def allows(self, state: int, arc: int) -> bool:
        """Whether the state behind a label has an arc, in the finished automaton."""
        born, now = self.born, len(self.born) + len(self.lost)
        while True:
            if self.lost.get((state, arc), now) < now:
                return False
            if born[state] < 0 and born[arc] < 0:
                return True
            if born[arc] > born[state]:  # the arc was added for an older one
                now = born[arc]
                if self.arc_of[arc] == state == self.state_of[arc]:
                    return False  # u + u: the state behind u lost its u arc in this very gadget
                arc = self.arc_of[arc]
            elif born[state] > born[arc]:  # the state is a copy of an older one
                now, state = born[state], self.state_of[state]
            else:  # a label after itself: the copy of its second part, the arc added for its first
                now, state, arc = born[arc], self.state_of[state], self.arc_of[arc]

    def _step(self, key: int) -> int:
        """Compute and keep the transition of (state, byte)."""
        byte, ends = key & 255, self.ends
        label, reached = -1, []
        for place in self.places[key >> 8]:
            node = self.child.get((place & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            behind = place >> 32
            if label < 0 and ends[node] >= 0 and (not behind or self.allows(behind - 1, ends[node])):
                label = ends[node]  # one path spells the prefix, so no other place ends an arc
            if self.goes_on[node]:
                reached.append(behind << 32 | node)
        reached.append((label + 1) << 32)
        state = tuple(reached)
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.places)
            self.places.append(state)
            self.last.append(label)
        self.table[key] = number
        return number

    def encode(self, word: bytes) -> Sequence[int]:
        """The ids of one pre-split word: the labels of the one path that spells it."""
        known, step, last = self.table.get, self._step, self.last
        # A word beyond the piece table's can be as long as a text, and so are its labels.
        labels, out = ([], []) if len(word) <= PIECE_LIMIT else (array("i"), array("i"))
        at = 0
        for byte in word:
            key = at << 8 | byte
            at = known(key)
            if at is None:
                if len(self.table) >= TRANSITION_LIMIT:  # also within a word
                    key = self._carry(key >> 8) << 8 | byte
                    known, last = self.table.get, self.last
                at = step(key)
            labels.append(last[at])
        end, lengths = len(labels), self.lengths
        while end:
            label = labels[end - 1]
            out.append(label)
            end -= lengths[label]
        out.reverse()
        return out


class Pieces(dict):
    """A bounded table from pieces of text to packed ids; the older half of it goes when it is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, piece: str):
        packed = self.older.get(piece)
        if packed is None:
            packed = self.compute(piece)
        if len(piece) <= PIECE_LIMIT:
            if len(self) >= TABLE_LIMIT:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Coder:
    """Encodes and decodes as the vocabulary file's own library does by default: strings of special
    tokens in a text become these tokens."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        check_settings(spec)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = list(self.automaton.labels)
        for content, i in self.special.items():
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = content.encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.split = regex.compile(PRE_SPLIT)
        self.word, self.spaced = Pieces(self._word), Pieces(self._spaced)

    def _word(self, word: str) -> bytes:
        return array("I", self.automaton.encode(word.encode())).tobytes()

    def _spaced(self, piece: str) -> bytes | None:
        """A piece between single spaces, with the space before it; None if its split depends on what is around."""
        if piece.isascii() and piece.isalpha():
            return self._word(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self._split(" " + piece)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.split.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Between single spaces the pre-split can't reach across, so pieces are looked up whole."""
        first, *rest = text.split(" ")
        if rest and not (first and first[-1].isspace()) and first:
            coded = list(map(self.spaced.__getitem__, rest))
            if None not in coded:
                return self._split(first) + b"".join(coded)
        return self._split(text)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                out.append(self._plain(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def _coder(source) -> Coder:
    """The coder of a broadcast vocabulary file; a worker compiles each file once."""
    text = source.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(text)
    return _coders[key]


def _broadcast(spark, tokenizer_path: str):
    """The vocabulary file as the driver reads it: a model of fixed size, not data."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array of token ids added."""
    source = _broadcast(docs.sparkSession, tokenizer_path)

    def ids(texts):
        coder = _coder(source)
        return [pa.array([np.frombuffer(coder.encode(t.as_py()), dtype="<u4").astype(np.int32) for t in texts], type=pa.list_(pa.int32()))]

    return add_columns(docs, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], text_col, ids)


def encode_checked(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with ids, n_tokens, and intact: whether decoding the ids gives the text back."""
    source = _broadcast(docs.sparkSession, tokenizer_path)

    def coded(texts):
        coder = _coder(source)
        packed = [coder.encode(t.as_py()) for t in texts]
        arrays = [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed]
        intact = [coder.decode(p) == (t.as_py() or "") for p, t in zip(packed, texts)]
        return [pa.array(arrays, type=pa.list_(pa.int32())), pa.array([len(a) for a in arrays], type=pa.int64()), pa.array(intact, type=pa.bool_())]

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("intact", T.BooleanType())]
    return add_columns(docs, added, text_col, coded, keep)


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the decoded text of an array of ids added; a null array decodes to the empty text."""
    source = _broadcast(docs.sparkSession, tokenizer_path)

    def texts(arrays):
        coder = _coder(source)
        return [pa.array([coder.decode(np.array(a.as_py() or [], dtype="<u4").tobytes()) for a in arrays], type=pa.string())]

    return add_columns(docs, [T.StructField(text_col, T.StringType())], ids_col, texts)


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_tokens, ids_sha256 and decoded_sha256 added, without ids between processes."""
    source = _broadcast(docs.sparkSession, tokenizer_path)

    def digests(texts):
        coder = _coder(source)
        n, ids, decoded = [], [], []
        for t in texts:
            packed = coder.encode(t.as_py())
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(packed).encode()).hexdigest())
        return [pa.array(n, type=pa.int64()), pa.array(ids), pa.array(decoded)]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return add_columns(docs, added, text_col, digests, keep)

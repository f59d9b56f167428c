"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words counts the letter subsequences of length ORDER that they share. Each is
weighted down by what it skips in the word: LETTER_GAP for a skipped letter, OTHER_GAP for any other
character. A landmark found in one piece counts 1; one with characters inserted or set apart counts
somewhat less, and one spread over another word's letters little. Landmarks are stems typical of toxic
training documents (letter n-grams that these documents hold far more often than others, and runs
of them) and frequent words of the others. A sentence is the largest kernel value that any of its
words has with each landmark, mapped by the inverse square root of the landmarks' own kernel matrix
(Nyström). A linear SVM is trained on labelled sentences: of a toxic document the one that scores
highest, chosen anew in each round, and of others those that come closest; besides, toxic landmarks
alone, as they are and with inserted characters. A document scores by its highest sentence, through a logistic curve fitted
on documents not trained on.

A word that is a toxic landmark in one piece but for a single letter inserted, or with letters drawn
out, has value INSERTED with it, unless clean training documents have that word; one that has the
landmark's letters in no one piece keeps the share SPREAD of its value. Single letters in a row are
also read as one word, and so are words that together spell a landmark, unless each of them is a word of
clean training documents. Words longer than WINDOW letters are read in overlapping windows. A word that shares no common subsequence of SHARED of a landmark's length with
it has kernel value 0; a bit-parallel test finds that, so most words cost little.

Training takes a bounded sample of labelled documents (train_docs); scoring takes every text whole.

Defined results: a null text is scored like an empty one. Without training labels of both kinds, or
without a typical stem, the score is the smoothed share of label 1. Repeated rows score alike; a null
doc_id isn't held out. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_bucket, labelled_sample

ORDER, LETTER_GAP, OTHER_GAP, SHARED = 4, 0.4, 0.99, 0.85
WINDOW, STRIDE = 32, 16
CLEAN_LANDMARKS, LONGEST_LANDMARK = 4, 16
#: Value of a landmark with one letter inserted, and the letters that may follow it.
INSERTED, ENDING = 0.9, 3
#: Share of its value that a word keeps in which the landmark stands in no one piece, signs aside.
SPREAD = 0.5
#: A stem's n-grams stand in this many times as many toxic documents as others, and so many documents that the
#: chance of it, were labels given at random, is below exp(-STEM_EVIDENCE): 1e-9, for a million n-grams tried.
STEM_ODDS, STEM_EVIDENCE, GRAM_SIZES, GRAM_BITS = 20, 20.7, (4, 5), 19
#: Landmarks that a toxic training document should have, if there are as many: so one that is rare alone is still chosen.
COVER = 3
#: Labelled documents that training takes, in the order of a hash of their ids.
TRAIN_DOCS = 6000
#: Bytes of which n-grams are in memory at a time.
SLICE_BYTES = 1 << 20
#: Weight of a clean sentence in training, over the number of clean documents, against one of all toxic ones.
CLEAN_WEIGHT = 10
TABLE_LIMIT = 300_000
_DRAWN = re.compile(rb"([a-z\x80-\xff])\1{2,}")
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS = b".!?"
_MARKS = frozenset(bytes([c]) for c in _EDGES)
#: Byte classes: padding 0, letters 1 to 26, bytes of other alphabets' letters from 27 on, the rest OTHER.
OTHER = 255
_CODE = np.full(256, OTHER, dtype=np.uint8)
_CODE[0], _CODE[97:123], _CODE[128:] = 0, np.arange(1, 27), np.arange(27, 155)
_BREAK = b"\x01"
#: Stands before the first letter of a word, and of stems that begin words; matched like a letter.
_START = b"\x02"
_CODE[2] = 155


def lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def letters(word: bytes) -> bytes:
    return _START + lower(word.strip(_EDGES))


def _matrix(words: list[bytes]) -> np.ndarray:
    width = max(map(len, words), default=0) or 1
    return _CODE[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(len(words), width)]


def common_subsequence(words: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each word and landmark, bit-parallel over landmark positions."""
    masks = np.zeros((256, len(landmarks)), dtype=np.uint16)
    for j in range(landmarks.shape[1]):
        masks[landmarks[:, j], np.arange(len(landmarks))] |= np.uint16(1 << j)
    masks[0] = masks[OTHER] = 0
    v = np.full((len(words), len(landmarks)), np.uint16(2**16 - 1))
    for i in range(words.shape[1]):
        u = v & masks[words[:, i]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v)


def raw_kernel(words: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of words with the same row of landmarks, by dynamic programming.

    ends[i][:, j] is the weight of subsequences of length i + 1 whose last letter is the landmark's
    letter j, stretched to the current place of the word; skipped landmark letters weigh LETTER_GAP.
    """
    n, m = landmarks.shape
    ends = np.zeros((ORDER - 1, n, m))
    total = np.zeros(n)
    for i in range(words.shape[1]):
        x = words[:, i : i + 1]
        hit = (landmarks == x) & (x > 0) & (x < OTHER)
        # before[:, :, j]: what a match at letter j extends, decayed over the landmark letters between.
        before = np.zeros((ORDER - 1, n, m))
        for j in range(1, m):
            before[:, :, j] = LETTER_GAP * before[:, :, j - 1] + ends[:, :, j - 1]
        total += np.where(hit, before[ORDER - 2], 0).sum(axis=1)
        gap = np.where(x == OTHER, OTHER_GAP, np.where(x == 0, 1.0, LETTER_GAP))
        # What ended earlier is stretched over this character; what ends here isn't.
        ends = ends * gap[None]
        ends[0] += hit
        ends[1:] += np.where(hit[None], before[: ORDER - 2], 0)
    return total


def one_letter_more(word: bytes, landmark: bytes) -> bool:
    """Whether the word holds the landmark in one piece but for one letter inserted into it, with a short ending, or drawn out letters."""
    for drawn in {word, _DRAWN.sub(rb"\1", word), _DRAWN.sub(rb"\1\1", word)}:
        if landmark in drawn and drawn != word:
            return True
        first = landmark[:1]
        at = drawn.find(first)
        while at >= 0:
            same = 0
            while same < len(landmark) and drawn[at + same : at + same + 1] == landmark[same : same + 1]:
                same += 1
            # The inserted letter stands behind the landmark's first letter (not its start mark) and before its last.
            inside = (2 if first == _START else 1) <= same < len(landmark)
            short = len(drawn) - (at + 1 + len(landmark)) <= ENDING
            if inside and short and drawn[at + same + 1 : at + 1 + len(landmark)] == landmark[same:] and _CODE[drawn[at + same]] not in (0, OTHER):
                return True
            at = drawn.find(first, at + 1)
    return False


class Landmarks:
    """The words that others are compared with, the first of them toxic ones.

    exceptions: clean words that resemble these by a letter, or that are pieces of them. Without known ones, pieces of
    ORDER letters or more are taken for words of their own.
    """

    def __init__(self, words: list[bytes], toxic: int, exceptions: frozenset[bytes] | None = None):
        self.words, self.toxic, self.codes = words, toxic, _matrix(words)
        self.exceptions = exceptions
        self.own = raw_kernel(self.codes, self.codes)
        self.sizes = np.array(list(map(len, words)))
        self.least = np.maximum(ORDER, np.ceil(SHARED * self.sizes))
        plain = [w.removeprefix(_START) for w in words[:toxic]]
        #: Beginnings of toxic landmarks, and these whole: what words may spell together.
        self.whole = frozenset(w for w in plain if len(w) >= ORDER)
        self.parts = frozenset(w[:i] for w in self.whole for i in range(1, len(w)))

    def is_word(self, piece: bytes) -> bool:
        """Whether a piece of a landmark is a word of clean documents."""
        return len(piece) >= ORDER if self.exceptions is None else piece in self.exceptions

    def pieces(self) -> set[bytes]:
        """What a landmark can be cut to by blanks."""
        return {w[i:j] for w in self.whole for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Kernel values as shares of the landmark's own, 1 at most; a row a word, a column a landmark."""
        codes = _matrix(words)
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        common = common_subsequence(codes, self.codes)
        w, l = np.nonzero(common >= self.least)
        for i in range(0, len(w), 1 << 13):
            a, b = w[i : i + (1 << 13)], l[i : i + (1 << 13)]
            out[a, b] = np.minimum(1, raw_kernel(codes[a], self.codes[b]) / self.own[b])
        w, l = np.nonzero(out[:, : self.toxic])
        for i, j in zip(w.tolist(), l.tolist()):
            if self.words[j] not in bytes(c for c in words[i] if _CODE[c] != OTHER):
                near = common[i, j] >= self.sizes[j] and words[i] not in (self.exceptions or ()) and one_letter_more(words[i], self.words[j])
                out[i, j] = INSERTED if near else SPREAD * out[i, j]
        return out

    def gram(self) -> np.ndarray:
        """The landmarks' own kernel matrix, normalised and symmetric."""
        n = len(self.words)
        a, b = np.divmod(np.arange(n * n), n)
        k = raw_kernel(self.codes[a], self.codes[b]).reshape(n, n) / np.sqrt(np.outer(self.own, self.own))
        return (k + k.T) / 2


class Table:
    """word -> 4 * (row of its kernel values) + 2 * (begins a landmark) + (ends a sentence); row 0 is all zeros. Emptied when full."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {_BREAK: 1}
        self.rows = np.zeros((1024, len(self.landmarks.words)), dtype=np.float32)
        self.used = 1

    def add(self, words: set[bytes]) -> None:
        """Compute what is missing, many words at once."""
        for w in (missing := [w for w in words if w not in self.codes]):
            self.codes[w] = 2 * (lower(w) in self.landmarks.parts) + (w[-1:] in _ENDS and len(w) > 2)
        pieces = []
        for w in missing:
            p = letters(w)
            if len(p) > WINDOW:
                pieces += [(p[i : i + WINDOW], w) for i in range(0, len(p) - STRIDE, STRIDE)]
            elif len(p) > ORDER:
                pieces.append((p, w))
        pieces.sort(key=lambda x: len(x[0]))  # so that short words aren't padded to long ones
        best: dict[bytes, np.ndarray] = {}
        for k in range(0, len(pieces), 2048):
            part = pieces[k : k + 2048]
            values = self.landmarks.kernel([p for p, _ in part])
            for i in np.flatnonzero(values.any(axis=1)).tolist():
                w = part[i][1]
                best[w] = np.maximum(best[w], values[i]) if w in best else values[i]
        while self.used + len(best) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for w, values in best.items():
            self.rows[self.used] = values
            self.codes[w] += 4 * self.used
            self.used += 1

    def sentences(self, words: list[bytes]) -> np.ndarray:
        """Kernel vectors of the sentences in which some word resembles a landmark."""
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.int64, count=len(words))
        spelled = self._spelled(words, np.flatnonzero(codes & 2).tolist())
        if spelled:
            self.add(set(spelled.values()).difference(self.codes))
            for i, w in spelled.items():
                codes[i] = self.codes[w] & ~3 | codes[i] & 1
        at = np.flatnonzero(codes > 3)
        if not len(at):
            return self.rows[:0]
        number = np.cumsum(codes & 1)[at] - (codes[at] & 1)
        first = np.flatnonzero(np.r_[True, np.diff(number) > 0])
        return np.maximum.reduceat(self.rows[codes[at] >> 2], first, axis=0)

    def _spelled(self, words: list[bytes], begins: list[int]) -> dict[int, bytes]:
        """{place of the first: joined by blanks} of words that together spell a toxic landmark, or its plural."""
        parts, whole, found = self.landmarks.parts, self.landmarks.whole, {}
        for i in begins:
            text, joined = lower(words[i]), words[i]
            odd = not self.landmarks.is_word(text)
            for w in words[i + 1 : i + LONGEST_LANDMARK]:
                end = lower(w.rstrip(_EDGES))
                odd |= not self.landmarks.is_word(end)
                if text + end in whole or (text + end)[:-1] in whole and end[-1:] == b"s":
                    if odd:
                        found[i] = joined + b" " + w
                    break
                text, joined = text + lower(w), joined + b" " + w
                if text not in parts:
                    break
        return found


def split_words(text: bytes | None) -> list[bytes]:
    """Words, breaks at line ends, and behind each run of ORDER or more single letters the word that they spell, whole and without its first letter."""
    words = (text or b"").replace(b"\n", b" \x01 ").split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    single = np.array([i for i in np.flatnonzero(lengths <= 2).tolist() if lengths[i] == 1 or words[i][1:] in _MARKS], dtype=np.int64)
    if len(single) < ORDER:
        return words
    out, last = [], 0
    for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
        spelled = b"".join(w[:1] for w in words[run[0] : run[-1] + 1])
        for part in spelled.split(_BREAK):
            if len(part) >= ORDER:
                out += words[last : run[-1] + 1] + [part, part[1:]]
                last = run[-1] + 1
    return out + words[last:]


_tables: dict[tuple, Table] = {}


def _sentences(landmarks: Landmarks, texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sentence vectors of each text; new words of several texts are computed together."""
    key = (tuple(landmarks.words), landmarks.toxic, landmarks.exceptions)
    if key not in _tables:
        _tables.clear()  # of an earlier model
        _tables[key] = Table(landmarks)
    table = _tables[key]
    for i in range(0, len(texts), 128):
        part = [split_words(t) for t in texts[i : i + 128]]
        if len(table.codes) > TABLE_LIMIT:
            table.clear()
        table.add(set(chain.from_iterable(part)).difference(table.codes))
        yield from map(table.sentences, part)


def _grams(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(which size, places, buckets) of the n-grams of letters of a text, slice by slice."""
    whole = np.frombuffer(lower(text), dtype=np.uint8)
    for start in range(0, len(whole), SLICE_BYTES):
        for which, n in enumerate(GRAM_SIZES):
            raw = whole[start : start + SLICE_BYTES + n - 1]  # each n-gram begins in one slice
            letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
            reach = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum(letter, out=reach[1:])
            places = np.flatnonzero(reach[n:] - reach[:-n] == n) if len(raw) >= n else np.zeros(0, dtype=np.int64)
            h = np.full(len(places), n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ raw[places + k]) * np.uint32(0x01000193)
            yield which, places + start, (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)


def evident(toxic: np.ndarray, clean: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether so many of the documents with an n-gram are toxic that it can't well be chance (Chernoff's bound of the binomial tail)."""
    n, p = toxic + clean, docs[1] / max(1, docs.sum())
    share = toxic / np.maximum(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        heads = np.where(toxic > 0, toxic * np.log(share / p), 0)
        tails = np.where(clean > 0, clean * np.log((1 - share) / (1 - p)), 0)
    return (share > p) & (heads + tails >= STEM_EVIDENCE)


def toxic_grams(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """(which n-gram buckets are typical of toxic documents, toxic documents, clean documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, len(GRAM_SIZES), 1 << GRAM_BITS), dtype=np.uint32)
        docs = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                docs[label] += 1
                held = [np.zeros(0, dtype=np.uint32)] * len(GRAM_SIZES)
                for which, _, h in _grams(text):
                    held[which] = np.union1d(held[which], h)
                for which, h in enumerate(held):
                    table[label, which, h] += 1
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([docs.tolist()], pa.list_(pa.int64()))], names=["t", "docs"])

    total, docs = np.zeros((2, len(GRAM_SIZES), 1 << GRAM_BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for r in sample.coalesce(8).mapInArrow(run, "t binary, docs array<bigint>").toLocalIterator():  # eight tables of fixed size at most
        total += np.frombuffer(r.t, dtype=np.uint32).reshape(total.shape)
        docs += r.docs
    clean, toxic = total
    return evident(toxic, clean, docs) & (toxic * (docs[0] + 2) >= STEM_ODDS * (clean + 1) * max(1, docs[1])), int(docs[1]), int(docs[0])


def stems(text: bytes, typical: np.ndarray) -> set[bytes]:
    """Typical n-grams of a text, and the maximal runs of letters that they cover, with _START where they begin a word."""
    raw = lower(text)
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    spans: list[tuple[int, int]] = []
    for which, places, h in _grams(text):
        at, n = places[typical[which, h]], GRAM_SIZES[which]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        spans += [(a, a + n) for a in at.tolist()]
    covered = np.r_[0, (np.cumsum(edge) > 0)[:-1].astype(np.int8), 0]
    starts, stops = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
    spans += [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a < LONGEST_LANDMARK]
    inside = lambda a: a > 0 and (raw[a - 1] >= 128 or 97 <= raw[a - 1] <= 122)
    return {raw[a:b] if inside(a) else _START + raw[a:b] for a, b in spans}


def pick_stems(docs: dict[bytes, set[int]]) -> list[bytes]:
    """Toxic landmarks from {stem: toxic documents that hold it}: the most widespread stems that no landmark
    chosen before finds, as long as some documents have fewer than COVER of them, each made as long as
    it can be without losing more than a tenth of its documents. Stems within words (endings, mostly)
    are taken only for documents that lack the others."""
    chosen: list[bytes] = []
    covered: set[int] = set()
    times: Counter[int] = Counter()
    for stem in sorted(docs, key=lambda s: (_START not in s, -len(docs[s]), -len(s), s)):
        if all(times[d] >= COVER for d in docs[stem]):
            continue
        if chosen and Landmarks(chosen, 0).kernel([stem]).max() > 0.6 or any(stem in c for c in chosen):
            continue
        if _START not in stem and len(docs[stem] - covered) < max(3, 0.1 * len(docs[stem])):
            continue
        longest = max((s for s in docs if stem in s and len(docs[s]) >= 0.9 * len(docs[stem])), key=lambda s: (len(s), len(docs[s]), s))
        chosen.append(longest)
        covered |= docs[longest]
        times.update(docs[longest])
    return chosen


def choose_landmarks(sample: DataFrame, clean_landmarks: int = CLEAN_LANDMARKS) -> tuple[Landmarks | None, int, int]:
    """(landmarks, toxic documents, clean documents) of a sample (label, text as binary)."""
    typical, n1, n0 = toxic_grams(sample)
    held = sample.sparkSession.sparkContext.broadcast(typical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, s) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for s in stems(t, held.value)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["doc_id", "stem"])

    counted = sample.filter("label = 1").select("doc_id", "text").mapInArrow(run, "doc_id bigint, stem binary").groupBy("stem").agg(F.collect_set("doc_id").alias("docs"))
    # Bounded by the sample: stems are made of n-grams of its toxic documents.
    most = counted.filter(F.size("docs") > 1).collect()
    chosen = pick_stems({bytes(r.stem): set(r.docs) for r in most})
    if not chosen:
        return None, n1, n0
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(f"[a-z]{{{ORDER},12}}"), F.lit(0)))).alias("w")
    common = sample.filter("label = 0").select(word).groupBy("w").count().orderBy(F.desc("count"), "w").limit(clean_landmarks).collect()
    words = chosen + [_START + r.w.encode() for r in common if _START + r.w.encode() not in chosen]
    return Landmarks(words, len(chosen), clean_resemblances(sample, Landmarks(words, len(chosen)))), n1, n0


def clean_resemblances(sample: DataFrame, landmarks: Landmarks) -> frozenset[bytes]:
    """Words of the sample's clean documents that are a letter away from a toxic landmark (with their start mark), or a piece of one."""
    held = sample.sparkSession.sparkContext.broadcast((landmarks.words[: landmarks.toxic], landmarks.pieces()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, pieces = held.value
        words = {letters(w) for b in batches for t in b.column("text") for w in (t.as_py() or b"").split()}
        found = {w for w in words if ORDER < len(w) <= WINDOW and any(one_letter_more(w, x) for x in toxic)}
        found |= pieces.intersection(w.removeprefix(_START) for w in words)
        found = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["word"])

    return frozenset(bytes(r.word) for r in sample.filter("label = 0").select("text").mapInArrow(run, "word binary").distinct().collect())


def with_insertions(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a sign or digit inserted at a random place, with a letter, and with a sign between all letters."""
    word = word.removeprefix(_START)
    other = bytes([rng.choice(np.frombuffer(b"-*._~0", dtype=np.uint8))])
    at = int(rng.integers(1, len(word)))
    letter = bytes([rng.integers(97, 123)])
    return [word[:at] + other + word[at:], word[:at] + letter + word[at:], other.join(bytes([c]) for c in word)]


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, epochs: int = 300) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, y in -1, 1) by Newton steps over the rows within the margin."""
    z = np.c_[x, np.ones(len(x))]
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    w, before = np.zeros(z.shape[1]), None
    for _ in range(epochs):
        inside = y * (z @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        a, s = z[inside], weight[inside] / len(z)
        goal = np.linalg.solve(penalty + (a * s[:, None]).T @ a, (a * s[:, None]).T @ y[inside])
        w += 0.7 * (goal - w) if _ > 20 else goal - w
    return w[:-1], float(w[-1])


def fit_slope(m: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve from margins to probabilities, by damped Newton steps. The SVM's border stays at 0.5."""
    a = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m, -30, 30)))
        g, h = ((p - y) * m).sum() + 1e-2 * (a - 1), (p * (1 - p) * m * m).sum() + 1e-2
        a -= np.clip(g / h, -1, 1)
    return max(float(a), 1e-3)


class Model:
    def __init__(self, landmarks: Landmarks, w: np.ndarray, b: float, slope: float):
        # Nyström's map is linear, so the SVM's weights are kept as weights of kernel values.
        self.landmarks, self.w, self.b, self.slope = landmarks, w, b, slope

    def margin(self, sentences: np.ndarray) -> float:
        """Of the highest sentence, within the SVM's own margin of 1: what lies beyond is as certain.

        A sentence without any likeness to a landmark has the bias as its margin.
        """
        top = max(self.b, (sentences @ self.w + self.b).max()) if len(sentences) else self.b
        return float(np.clip(top, -1, 1))

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, label: str = "toxic", held_out=None, clean_landmarks: int = CLEAN_LANDMARKS) -> tuple[Model | None, float]:
    """(model, smoothed share of label 1), fitted on at most train_docs labelled documents that aren't held out."""
    held_out = held_out if held_out is not None else crc_bucket(F.col("doc_id"), 5) == 0
    sample = labelled_sample(docs, labels, label, ~held_out, train_docs)
    sample = sample.select("doc_id", F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    landmarks, n1, n0 = choose_landmarks(sample, clean_landmarks)
    share = (n1 + 1) / (n1 + n0 + 2)
    if landmarks is None or not n1 or not n0:
        return None, share
    toxic = landmarks.toxic
    held = sample.sparkSession.sparkContext.broadcast(landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(s, axis=0).tobytes() for s in _sentences(held.value, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    # The distinct sentences of the sampled documents that have any likeness to a landmark.
    got = sample.mapInArrow(run, "doc_id bigint, label int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    m = len(landmarks.words)
    zero = np.zeros((1, m), dtype=np.float32)
    bags = [np.r_[np.frombuffer(r.x, dtype=np.float32).reshape(-1, m), zero] for r in got]
    y = np.array([r.label for r in got])
    values, basis = np.linalg.eigh(landmarks.gram())
    whiten = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ basis.T
    rng = np.random.default_rng(0)
    calibrate = rng.random(len(bags)) < 0.2
    if len({*y[calibrate]}) < 2 or len({*y[~calibrate]}) < 2:
        calibrate[:] = False
    made = landmarks.kernel([_START + v for w in landmarks.words[:toxic] for v in (w.removeprefix(_START), *with_insertions(w, rng), *with_insertions(w, rng))])
    clean_bags = [b for b, label_, c in zip(bags, y, calibrate) if label_ == 0 and not c]
    # A document weighs as much as it has sentences that resemble a landmark, and its plain ones together as one.
    clean, n_clean = np.concatenate(clean_bags), len(clean_bags)
    w = np.r_[np.ones(toxic), np.zeros(m - toxic)]  # of kernel values; the first witnesses are the most alike
    b = 0.0
    for _ in range(4):
        # A toxic document without any likeness is no witness: its label says nothing about words.
        witness = np.array([bag[int(np.argmax(bag @ w))] for bag, label_, c in zip(bags, y, calibrate) if label_ == 1 and not c and bag.any()] or zero)
        x = np.concatenate([witness, made, clean])
        target = np.r_[np.ones(len(witness) + len(made)), -np.ones(len(clean))]
        weight = np.r_[np.full(len(witness), 0.5 / len(witness)), np.full(len(made), 1 / len(made)), np.full(len(clean), CLEAN_WEIGHT / n_clean)] * len(x)
        v, b = train_svm(x @ whiten, target, weight)
        w = whiten @ v
    model = Model(landmarks, w.astype(np.float32), b, 1.0)
    judged = calibrate if calibrate.any() else ~calibrate
    margins = np.array([model.margin(bag) for bag, c in zip(bags, judged) if c])
    model.slope = fit_slope(margins, y[judged].astype(float))
    return model, share


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share = fitted.value
        for batch in batches:
            if model is None:
                scores = [share] * batch.num_rows
            else:
                scores = [model.probability(model.margin(s)) for s in _sentences(model.landmarks, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = bound_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

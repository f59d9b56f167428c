"""Quality rules with risk-controlled thresholds.

Base counts of a text give rates (symbols, repeats, upper case and so on), and a rule rejects a
document whose rate is above a cutoff. Cutoffs are chosen per stratum (a band of lengths) from
labelled documents in two disjoint folds. The first proposes rules and cutoffs. The second, which the
proposals don't depend on, tests cutoffs of a proposed rule one after the other from the most
lenient to the proposal; the strictest one that passes is taken. A test passes if the exact
binomial tail says that, at the stated confidence, the share of the stratum's good documents above
the cutoff is at most the rule's part of the allowed risk. Risk is split over the rules proposed in a
stratum, the confidence over all proposals (Bonferroni); tests in a fixed order need no more.

Counts of labelled documents per rate bin are summed over all labelled rows; only that table, of
fixed size, reaches the driver.

Defined results: a null text has no words and fails the base rules. Labels that are null, neither 0
nor 1, or contradict each other for one id are not used; a null doc_id has no label. Repeated rows
are judged alike, each on its own. Without labels no cutoff is certified and the base rules decide
alone. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, add_columns, crc_bucket, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Lower borders of the strata, in words.
STRATA = (0, 150, 450)
RULES = ("symbol_rate", "bang_rate", "upper_rate", "dup_line_rate", "repeat_rate", "mean_word")
BINS = 400
#: All rules together may reject this share of a stratum's good documents, at this confidence.
RISK, CONFIDENCE = 0.02, 0.95
#: A good document lost weighs as many bad ones kept; the least gain for which a rule is proposed.
PRICE, MIN_GAIN = 20, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper")


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows that are found twice or more. Windows are compared by hash first, then exactly."""
    if len(words) <= width:
        return 0
    windows = lambda: zip(*(words[i:] for i in range(width)))
    hashes = np.fromiter(map(hash, windows()), dtype=np.int64, count=len(words) - width + 1)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    suspects = np.unique(np.r_[order[1:][same], order[:-1][same]])
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for at in suspects.tolist():
        seen.setdefault(tuple(words[at : at + width]), []).append(at)
    starts = np.fromiter(chain.from_iterable(x for x in seen.values() if len(x) > 1), dtype=np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text. bytes.split() splits at exactly the six ASCII spaces."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = text.split("\n")
    written = [x for x in lines if x.strip(SPACE_CHARS)]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words), len(text) - sum(map(text.count, SPACE_CHARS)), sum(map(text.count, SYMBOLS)),
        len(written) - len(set(written)), repeat_words(words), len(written), text.count("!"), upper,
    )


#: Counts travel in one column of this name, so that no column of the caller's is hidden.
RULE_COUNTS = "__rule_counts"


def _measure(texts: pa.Array) -> list[pa.Array]:
    table = np.array([counts(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
    return [pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))]


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with the counts of each row's text."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return add_columns(docs, [T.StructField(RULE_COUNTS, kind)], text_col, _measure, keep)


def count(name: str) -> Column:
    return F.col(f"{RULE_COUNTS}.{name}")


def base_failed() -> Column:
    return (count("n_words") < MIN_WORDS) | (100 * count("n_repeat_words") > REPEAT_PERCENT * count("n_words"))


def rates() -> dict[str, Column]:
    """Each rule's rate, 0 to 1; higher is worse."""
    share = lambda a, b: F.least(F.lit(1.0), count(a) / F.greatest(F.lit(1), count(b)))
    return {
        "symbol_rate": share("n_symbols", "word_chars"), "bang_rate": share("n_bangs", "word_chars"), "upper_rate": share("n_upper", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"), "repeat_rate": share("n_repeat_words", "n_words"),
        "mean_word": F.least(F.lit(1.0), count("word_chars") / F.greatest(F.lit(1), count("n_words")) / 40),
    }


def stratum() -> Column:
    return sum((count("n_words") >= b).cast("int") for b in STRATA[1:])


def rate_bins() -> Column:
    """The bin of each rule's rate; a document is rejected if its bin is at or above the cutoff's."""
    return F.array(*(F.floor(r * BINS).cast("int") for r in map(rates().get, RULES)))


def labelled(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fold, stratum, quality, bins) of every labelled document that passes the base rules."""
    agreed = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most").select("doc_id", "quality")
    )
    passed = measured.filter(~base_failed()).select(F.col(id_col).alias("doc_id"), stratum().alias("stratum"), rate_bins().alias("bins")).join(agreed, "doc_id")
    return passed.select(crc_bucket(F.col("doc_id"), 2).alias("fold"), "stratum", "quality", "bins")


def histogram(rows: DataFrame) -> dict[tuple[int, int, int], np.ndarray]:
    """Counts per bin, summed from the top, by (stratum, rule, quality). The table's size is fixed."""
    counted = rows.select("stratum", "quality", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "quality", "bin").count()
    table = {(s, r, q): np.zeros(BINS + 1, dtype=np.int64) for s in range(len(STRATA)) for r in range(len(RULES)) for q in (0, 1)}
    for r in counted.collect():  # at most strata x rules x 2 labels x bins
        table[r.stratum, r.rule, r.quality][r.bin] += r["count"]
    return {k: v[::-1].cumsum()[::-1] for k, v in table.items()}


def rejected(cutoffs: dict[tuple[int, int], int], bins: Column, stratum_: Column) -> Column:
    out = F.lit(False)
    for (s, rule), b in sorted(cutoffs.items()):
        out = out | ((stratum_ == s) & (bins[rule] >= b))
    return out


def propose(rows: DataFrame) -> dict[tuple[int, int], int]:
    """{(stratum, rule): bin}: in each stratum, rule after rule as long as one catches bad documents that the others miss.

    A cutoff's gain is the bad documents at or above it less PRICE times the good ones. Of cutoffs with
    equal gain the middle one is taken, which keeps its distance from either kind.
    """
    proposals: dict[tuple[int, int], int] = {}
    for _ in RULES:
        table = histogram(rows.filter(~rejected(proposals, F.col("bins"), F.col("stratum"))))
        fresh = {}
        for s in range(len(STRATA)):
            best = (MIN_GAIN - 1, 0, 0)
            for rule in range(len(RULES)):
                if (s, rule) not in proposals:
                    gain = table[s, rule, 0] - PRICE * table[s, rule, 1]
                    top = np.flatnonzero(gain == gain.max())
                    best = max(best, (int(gain.max()), -rule, int(top[len(top) // 2])))
            if best[0] >= MIN_GAIN:
                fresh[s, -best[1]] = best[2]
        if not fresh:
            break
        proposals |= fresh
    return proposals


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certify(proposals: dict[tuple[int, int], int], held: dict[tuple[int, int, int], np.ndarray], risk: float = RISK, confidence: float = CONFIDENCE) -> dict[tuple[int, int], int]:
    """Of the proposals, tested on held-out counts, what passes: {(stratum, rule): bin from which documents are rejected}."""
    cutoffs = {}
    for (s, rule), proposed in proposals.items():
        share = risk / sum(x == s for x, _ in proposals)
        level = (1 - confidence) / len(proposals)
        good = held[s, rule, 1]
        for b in range(BINS, proposed - 1, -1):
            if binomial_tail(int(good[b]), int(good[0]), share) > level:
                break
            cutoffs[s, rule] = b
    return cutoffs


def verdict(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", risk: float = RISK, confidence: float = CONFIDENCE) -> Column:
    """Whether the rules, with cutoffs learned from all labelled rows of measured, keep a row of it."""
    rows = materialize(labelled(measured, labels, id_col), measured.count())
    cutoffs = certify(propose(rows.filter("fold = 1")), histogram(rows.filter("fold = 0")), risk, confidence)
    return ~base_failed() & ~rejected(cutoffs, rate_bins(), stratum())


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, counts, base_failed, kept): one row per document."""
    measured = materialize(measure(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"]))
    kept = verdict(measured, labels, "doc_id", risk, confidence)
    return measured.select("doc_id", *(count(c).alias(c) for c in COUNTS), base_failed().alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, as they are. Rows are written with their counts once; no text is shuffled."""
    measured = materialize(measure(docs, text_col))
    return measured.filter(verdict(measured, labels, id_col)).select(*docs.columns)

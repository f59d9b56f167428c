"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage works on all that the one before has kept. All but the last return the columns of
documents; n_chars follows the text.

Defined results: a null text has no words, so the rules reject its row. Line dedup may empty a text;
its row stays, and near-dedup keeps one of all empty texts, of which mixing takes none. A null doc_id
has no label and is never the id that is kept if its copies have one; a null source is a source of its
own; a null lang is carried along. Rows repeated in all columns are copies, of which one stays. Further
columns pass through all stages but the last, whatever their names. Ties go to smaller ids, then
text hashes. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import bpe, line_dedup, mixing, quality_rules, signatures
from meshwright.llm.common import materialize, read
from meshwright.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep. A text may become empty; its row stays."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a similarity of 0.8 or more over five-word shingles join: the one with the smallest id."""
    return signatures.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, intact); intact says that the ids decode to the text."""
    return bpe.encode_checked(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", mixture),
    ("bpe encoding", tokens),
]

#: SQL can't express the calibrated rules, fingerprints or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

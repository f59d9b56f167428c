"""Line deduplication, DataFrame functions only.

Hashes of long lines are aggregated per salt, range-partitioned and sorted by document, and the
first row of each hash streams out as its one keeper. What comes back is a run-length compressed
bitmap of kept lines per document; texts never travel with the hashes.

Defined results: a null or empty text is one empty line, which stays. A null doc_id is a document
like any other, but never the largest; if all holders of a line have null ids, nothing is dropped.
Rows that repeat a doc_id count as documents of their own, and rows with the largest doc_id all
keep the line. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, join_hot, materialize

#: Rows into which the copies of one line are pre-aggregated, so that no line gathers in one task.
SALTS = 32


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Names a row by id and text. Equal rows share it, and their lines then fare alike."""
    return [F.coalesce(id_col, F.lit(0).cast("bigint")).alias("k_id"), F.xxhash64(id_col.isNull(), text).alias("k_text")]


#: Names of the row key in frames that carry their caller's columns.
KEY = ["__k_id", "__k_text"]


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns(dict(zip(KEY, row_key(F.col(id_col), F.col(text_col)))))


def keyed(names: DataFrame) -> DataFrame:
    """A frame with k_id and k_text, these renamed to join a with_row_key() frame."""
    return names.withColumnsRenamed(dict(zip(("k_id", "k_text"), KEY)))


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """One row per document: its key, its number of lines, and (hash, position, first) of its long lines.

    Lines are sorted by hash within the document, which marks the first of equal ones without a
    shuffle. Two 64-bit hashes with different seeds name a line.
    """
    text = F.col(text_col)
    keys = F.transform(split_lines(text), lambda x: ascii_lower(F.btrim(x, F.lit(SPACE_CHARS))))
    found = F.transform(
        keys,
        lambda k, i: F.when(
            F.length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos")),
        ),
    )
    base = docs.select(
        F.col(id_col).alias("doc_id"), *row_key(F.col(id_col), text),
        F.size(split_lines(text)).alias("n_lines"), F.array_sort(F.array_compact(found)).alias("hashed"),
    )
    mark = F.transform(
        "hashed",
        lambda x, i: F.struct(
            x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"),
            ((i == 0) | (F.get("hashed", i - 1).h1 != x.h1) | (F.get("hashed", i - 1).h2 != x.h2)).alias("first"),
        ),
    )
    return base.withColumn("hashed", mark)


def keepers(occurrences: DataFrame, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keeper, docs) of each line found in min_docs documents or more.

    Salted partial counts bound every line to SALTS rows; these are range-partitioned by hash,
    sorted by document, and the first one of each hash is taken as it streams by.
    """
    partial = (
        occurrences.filter("first")
        .groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id", "k_text"), F.lit(SALTS)).alias("salt"))
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    )
    ranged = partial.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("last"))
    by_line = W.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("last"))
    return (
        ranged.withColumn("rank", F.row_number().over(by_line))
        .withColumn("docs", F.sum("n").over(W.partitionBy("h1", "h2")))
        .filter((F.col("rank") == 1) & (F.col("docs") >= min_docs))
        .select("h1", "h2", F.col("last").alias("keeper"), "docs")
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(k_id, k_text, n_lines, n_dropped, keep_runs): one row per distinct (id, text).

    keep_runs is the bitmap of kept lines as runs (start, length) in ascending order.
    """
    index = materialize(line_index(docs, id_col, text_col, min_chars))
    lines = index.select("doc_id", "k_id", "k_text", F.inline("hashed"))
    total = index.agg(F.coalesce(F.sum(F.size("hashed")), F.lit(0))).first()[0]
    found = materialize(keepers(lines, min_docs), total)
    dropped = (
        join_hot(lines, found, ["h1", "h2"], "docs", total)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("k_id", "k_text", F.lit(None).cast("int").alias("n_lines"), "pos")
    )
    every = index.select("k_id", "k_text", "n_lines", F.lit(None).cast("int").alias("pos"))
    gathered = every.unionByName(dropped).groupBy("k_id", "k_text").agg(
        F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("dropped")
    )
    gap = lambda i: (  # noqa: E731  the lines between dropped ones, the ends included
        F.when(i == 0, 0).otherwise(F.get("dropped", i - 1) + 1),
        F.coalesce(F.get("dropped", i), F.col("n_lines")),
    )
    runs = F.transform(
        F.sequence(F.lit(0), F.size("dropped")),
        lambda i: F.struct(gap(i)[0].alias("start"), (gap(i)[1] - gap(i)[0]).alias("length")),
    )
    return gathered.select(
        "k_id", "k_text", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"),
        F.filter(runs, lambda r: r.length > 0).alias("keep_runs"),
    )


def apply_bitmap(text: Column, keep_runs: Column) -> Column:
    """The text of the kept lines, joined by newlines."""
    return F.array_join(
        F.flatten(F.transform(keep_runs, lambda r: F.slice(split_lines(text), r.start + 1, r.length))), "\n"
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added (in place of columns so named), one row for each row of docs.

    Texts meet their bitmaps in one join.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    bitmaps = keyed(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)).withColumnsRenamed({"n_lines": "__n_lines", "n_dropped": "__n_dropped", "keep_runs": "__keep_runs"})
    joined = with_row_key(docs, id_col, text_col).join(bitmaps, KEY)
    whole = F.when(F.col("__n_dropped") == 0, F.coalesce(text_col, F.lit("")))
    # Lines are split once per dropped document: a let-binding through a one-element array.
    kept = F.element_at(
        F.transform(
            F.array(split_lines(F.col(text_col))),
            lambda a: F.array_join(F.flatten(F.transform("__keep_runs", lambda r: F.slice(a, r.start + 1, r.length))), "\n"),
        ),
        1,
    )
    return joined.select(
        *(c for c in docs.columns if c not in added),
        F.col("__n_lines").cast("bigint").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), whole.otherwise(kept).alias("kept_text"),
    )

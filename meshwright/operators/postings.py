"""Search for parts of names by a table of trigrams, so that a needle meets nodes that may hold it alone.

A needle is looked up by the rarest of its trigrams and what that yields is checked by contains, so the
result is that of a scan. Needles shorter than a trigram are compared with the shorter grams of all
nodes, by an equality join too. Letters are code points, and case counts. An empty or null needle
finds nothing; a node without a name or fqn is found by the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .traverse import ID, scoped

#: Letters of a gram.
SIZE = 3


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct runs of size letters of a text, in one pass over it; none of a null or shorter text."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _of_node(size: int) -> Column:
    return F.array_union(grams(F.col("name"), size), grams(F.col("fqn"), size))


def postings(nodes: DataFrame) -> DataFrame:
    """(repo_id, gram, file_path, node_id): the trigrams of each node's name and fqn."""
    return nodes.select("repo_id", F.explode(_of_node(SIZE)).alias("gram"), "file_path", "node_id")


def rarest(table: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, gram): of each needle of SIZE letters or more the gram that fewest rows of postings have, maybe none."""
    asked = needles.select("needle", F.explode(grams(F.col("needle"))).alias("gram"))
    # Counted before they meet the needles: each task sends a gram once, so one that most nodes have gathers nowhere.
    counts = table.groupBy("gram").agg(F.count("*").alias("n"))
    counted = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def containing(nodes: DataFrame, table: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, repo_id, node_id): nodes whose name or fqn holds a needle, for a table of any number of needles; table: their postings.

    The postings of the needles' rarest grams are what is joined with the nodes. They are picked where they lie: different
    grams, and needles shorter than one, are as few as letters allow, however many needles there are.
    """
    nodes, needles = scoped(nodes).select(*ID, "name", "fqn"), needles.select("needle").filter("needle <> ''").distinct()
    chosen = materialize(rarest(table, needles))
    held = scoped(table).join(F.broadcast(chosen.select("gram").distinct()), "gram", "left_semi")
    may = held.join(chosen, "gram").select("needle", *ID)
    long = may.join(nodes, ID).filter(F.contains("name", F.col("needle")) | F.contains("fqn", F.col("needle")))  # a null is no hit unless the other is one
    every = F.explode(F.concat(*(_of_node(n) for n in range(1, SIZE))))
    short = nodes.select(*ID, every.alias("needle")).join(F.broadcast(needles.filter(F.length("needle") < SIZE)), "needle")
    return long.select("needle", *ID).unionByName(short.select("needle", *ID))

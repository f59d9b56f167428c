"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a pair of aggregations and joins over the links; nothing about them reaches the driver
but one count and one checksum a round. Rounds grow with the logarithm of the component size. A node
with more than a thousandth of the links is joined apart, so that a hub doesn't gather in one task.

Defined results: links that have a null end, or the same node at both, give no row, nor does an empty
table. Repeated links, and links given from either end, count once. A node on no other link isn't in
the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard
from .common import HOT_SHARE, join_hot, materialize

#: So many links fit a task; a node with no more isn't joined apart.
FEW = 10_000


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of links (a, b: longs), root the smallest node it reaches. rows: about how many links there are."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    before = None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != before:
        before = now
        if now[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = 2 * now[0]
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), ends)
        hub = least.agg(F.max("n")).first()[0] > max(FEW, ends * HOT_SHARE)
        joined = join_hot(both.filter("b > a"), least, ["a"], "n", ends) if hub else both.filter("b > a").join(least, "a")
        large = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(parent, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        old, edges = edges, materialize(moved.unionByName(parent.select("a", F.col("m").alias("b"))).distinct(), ends)
        discard(old)
        discard(least)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

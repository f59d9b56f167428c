"""Ranking: normalised signals, weighted scores, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_match
from .traverse import ID, scoped

# Fixed values.
WEIGHTS = {"semantic": 0.35, "centrality": 0.25, "name_match": 0.20, "recency": 0.10, "proximity": 0.10}
RRF_K = 60
#: Rows of a result set beyond which it is met by broadcast, where its rows lie; fewer sets than one in so many rows are.
MANY_ROWS = 100_000


def weighted(semantic: Column, centrality: Column, name: Column, recency: Column, proximity: Column) -> Column:
    signals = dict(zip(WEIGHTS, (semantic, centrality, name, recency, proximity)))
    return sum(WEIGHTS[k] * F.coalesce(c, F.lit(0.0)) for k, c in signals.items())


def rank(results: DataFrame, terms: Column | None = None, order: str = "input_rank", partition: tuple[str, ...] = ()) -> DataFrame:
    """results with the signals normalised over the result set, score, and position; equal scores keep their order.

    The greatest values of each set are aggregated and joined, so that a score gathers no set in one
    task; a position, where it is read, orders each set. Results are read twice.
    """
    sets = results.groupBy(*(F.col(c).alias(f"_set_{c}") for c in partition)).agg(F.max("centrality_score").alias("_most_central"), F.max("importance_score").alias("_most_recent"), F.count("*").alias("_rows"))
    if partition:
        same = [F.col(c).eqNullSafe(F.col(f"_set_{c}")) for c in partition]  # a null names a set, too
        large = F.broadcast(sets.filter(F.col("_rows") > MANY_ROWS))
        joined = results.join(large, same).unionByName(results.join(large, same, "left_anti").join(sets.filter(F.col("_rows") <= MANY_ROWS), same))
    else:
        joined = results.crossJoin(F.broadcast(sets))
    share = lambda c, most: F.coalesce(c, F.lit(0.0)) / F.coalesce(F.nullif(F.col(most), F.lit(0.0)), F.lit(1.0))
    found = name_match(terms, F.col("fqn"), F.col("name")) if terms is not None else F.lit(0.0)
    scored = joined.withColumns({
        "centrality_signal": share(F.col("centrality_score"), "_most_central"), "recency_signal": share(F.col("importance_score"), "_most_recent"), "name_signal": found,
    }).drop(*sets.columns)
    scored = scored.withColumn("score", weighted(F.col("semantic_score"), F.col("centrality_signal"), F.col("name_signal"), F.col("recency_signal"), F.lit(0.0)))
    return scored.withColumn("position", F.row_number().over(W.partitionBy(*partition).orderBy(F.desc("score"), order)))


def fuse(graph: DataFrame, vector: DataFrame, top_k: int = 20) -> DataFrame:
    """(repo_id, node_id, rrf, semantic_score): two ranked lists (repo_id, node_id, rank from 1, semantic_score) fused; ties keep graph order first."""
    g = scoped(graph).select(*ID, F.col("rank").alias("g"), F.coalesce("semantic_score", F.lit(0.0)).alias("gs"))
    v = scoped(vector).select(*ID, F.col("rank").alias("v"), F.coalesce("semantic_score", F.lit(0.0)).alias("vs"))
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    fused = g.join(v, ID, "full_outer").withColumn("rrf", part("g") + part("v")).withColumn("semantic_score", F.greatest(F.coalesce("gs", F.lit(0.0)), F.coalesce("vs", F.lit(0.0))))
    return fused.orderBy(F.desc("rrf"), F.col("g").isNull(), "g", "v").limit(top_k).select(*ID, "rrf", "semantic_score")

"""Review context: from changed line ranges to touched symbols, their neighbourhood, and a budgeted selection.

Everything is done for all hunks and seeds at once. Lines meet symbols through the file path and cells
of lines, each of which keeps its best symbol, so work doesn't grow with the pairs that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SYMBOL_TYPES
from ..tables import materialize
from . import find, intervals
from .packing import SEPARATOR, greedy_fit_stream, header
from .traverse import ID, scoped, steps

# Reasons by priority, and their weights.
REASON_WEIGHT = {"touched": 1.0, "test": 0.65, "caller": 0.55, "callee": 0.40, "impacted": 0.30, "related_config": 0.20}
DISTANCE_WEIGHT = IMPORTANCE_WEIGHT = 0.20
PER_SEED, TAGS_USED, CONFIGS_PER_TAG = 8, 3, 2


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key), F.lit(default))


def priority(reason: Column) -> Column:
    return _lookup({r: i for i, r in enumerate(REASON_WEIGHT)}, reason, len(REASON_WEIGHT))


def score(reason: Column, distance: Column, importance: Column) -> Column:
    return _lookup(REASON_WEIGHT, reason, 0.1) + DISTANCE_WEIGHT / (1 + F.greatest(distance, F.lit(0))) + IMPORTANCE_WEIGHT * F.coalesce(importance, F.lit(0.0))


def narrowest(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hunk_id, repo_id, node_id, ..): the symbol that each hunk (hunk_id, file_path, start_line, end_line) touches.

    The first of the symbol types with an overlap, and the shortest, then first, span of it. A span or
    hunk that ends before it begins is its first line.
    """
    rank = _lookup({t: i for i, t in enumerate(SYMBOL_TYPES)}, F.col("node_type"), 99)
    touched = materialize(hunks.select("file_path").distinct())  # of known size, so a short list goes to the nodes
    symbols = scoped(nodes).filter(F.col("node_type").isin(*SYMBOL_TYPES) & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()).join(touched, "file_path", "left_semi")
    best = F.struct(rank.alias("rank"), (F.col("end_line") - F.col("start_line")).alias("lines"), F.col("start_line").alias("sl"), "node_id", "repo_id", F.col("end_line").alias("el"), "node_type", "fqn")
    spans = symbols.select("file_path", F.greatest("start_line", F.lit(0)).alias("low"), F.greatest("start_line", "end_line", F.lit(0)).alias("high"), best.alias("best"))
    placed = hunks.withColumns({"_low": F.greatest("start_line", F.lit(0)), "_high": F.greatest("start_line", "end_line", F.lit(0))})
    # Hunks of the same lines touch the same symbol, so one of them asks.
    probes = placed.groupBy("file_path", F.col("_low").alias("low"), F.col("_high").alias("high")).agg(F.min("hunk_id").alias("hunk_id"))
    asked = probes.join(intervals.least_overlapping(probes, spans, "file_path", "hunk_id", "best"), "hunk_id")
    found = asked.select("file_path", F.col("low").alias("_low"), F.col("high").alias("_high"), "best")
    return placed.join(found, ["file_path", "_low", "_high"]).select(*hunks.columns, "best.repo_id", "best.node_id", "best.node_type", "best.fqn", "best.sl", "best.el")


def seeds(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, node_id, ord): touched nodes, each once, in the order of their first hunk.

    hunks: (ord, hunk_id, file_path, start_line, end_line, is_new, is_deleted). A hunk without a symbol
    falls back to its file; a deleted file to its File and ConfigFile nodes; files not indexed give none.
    """
    live = hunks.filter(~F.col("is_deleted") & F.col("start_line").isNotNull())
    # Of the hunks of the same lines the first one tells.
    live = materialize(live.groupBy("file_path", "start_line", "end_line").agg(F.min(F.struct("ord", "hunk_id")).alias("f")).select("f.*", "file_path", "start_line", "end_line"))
    symbol = narrowest(live, nodes).select("ord", *ID)
    files = scoped(nodes).filter(F.col("node_type").isin("File", "ConfigFile")).select(*ID, "file_path", (F.col("node_type") == "ConfigFile").cast("int").alias("second"))
    bare = live.join(symbol.select("ord"), "ord", "left_anti").join(files, "file_path")
    fallback = bare.groupBy("ord").agg(F.min(F.struct("second", "node_id", "repo_id")).alias("f")).select("ord", "f.repo_id", "f.node_id")
    gone = hunks.filter("is_deleted").join(files, "file_path").select((F.col("ord") + F.col("second") * 0.5).alias("ord"), *ID)
    every = symbol.unionByName(fallback).select(F.col("ord").cast("double").alias("ord"), *ID).unionByName(gone)
    return materialize(every.groupBy(*ID).agg(F.min("ord").alias("ord")))


def related_configs(seeds_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, seed, node_id, ord): for each of a seed's first tags, two configuration files of its repository that carry it."""
    tags = scoped(seeds_).select("repo_id", F.col("node_id").alias("seed"), F.posexplode(F.slice("tags", 1, TAGS_USED)).alias("t", "tag"))
    configs = scoped(nodes).filter(F.col("node_type") == "ConfigFile").select(*ID, F.explode("tags").alias("tag"))
    # Two a tag, chosen before the join: WindowGroupLimit trims each tag's files on the map side.
    two = configs.withColumn("k", F.row_number().over(W.partitionBy("repo_id", "tag").orderBy("node_id"))).filter(F.col("k") <= CONFIGS_PER_TAG)
    return tags.join(two, ["repo_id", "tag"]).groupBy("repo_id", "seed", "node_id").agg(F.min(F.col("t") * CONFIGS_PER_TAG + F.col("k")).alias("ord"))


def cap_and_merge(candidates: DataFrame, per_seed: int = PER_SEED) -> DataFrame:
    """(repo_id, node_id, reason, distance): candidates (repo_id, seed, node_id, reason, distance, ord) cut per seed, then merged.

    Each seed keeps its best per_seed, duplicates included; a node keeps its best reason and distance.
    """
    best = W.partitionBy("repo_id", "seed").orderBy(priority(F.col("reason")), "distance", "ord", "node_id")
    kept = scoped(candidates).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= per_seed)
    chosen = F.min_by(F.struct("reason", "distance"), F.struct(priority(F.col("reason")), F.col("distance")))
    return kept.groupBy(*ID).agg(chosen.alias("c")).select(*ID, "c.reason", "c.distance")


def best_upstream(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """(repo_id, seed, node_id, k): the limit most important nodes that reach a seed in at most depth steps; k is their place.

    Each round gives every node near the seeds its own best limit nodes of that many steps, from those
    of its neighbours; so what moves grows with edges times limit, not with what the seeds reach.
    """
    named = scoped(nodes).select(*ID, F.coalesce("importance_score", F.lit(0.0)).alias("score"))
    back = steps(edges, "in")
    # Nodes fewer than depth steps from a seed, whose lists are all that is needed, and the steps from them.
    # Only these steps are sent, made distinct and written, those of each node once.
    fresh = materialize(scoped(seeds_).select("repo_id", F.col("node_id").alias("at")).distinct())
    near, hops = fresh, []
    for d in range(depth):
        found = materialize(back.join(fresh, ["repo_id", "at"], "left_semi").distinct())
        hops.append(hops[-1].unionByName(found) if hops else found)
        if d < depth - 1:
            fresh = materialize(found.select("repo_id", F.col("to").alias("at")).distinct().join(near, ["repo_id", "at"], "left_anti"))
            near = near.unionByName(fresh)
    order = F.desc("score"), "node_id"
    lists = None
    for d in range(1, depth + 1):
        ahead = hops[depth - d]
        found = ahead.withColumnRenamed("to", "node_id").join(named, ID).select("repo_id", "at", "node_id", "score")
        if lists is not None:
            further = lists.withColumnRenamed("at", "to")
            found = found.unionByName(ahead.join(further, ["repo_id", "to"]).select("repo_id", "at", "node_id", "score")).distinct()
        # One more than asked for: a node may be upstream of itself, and isn't counted.
        places = found.withColumn("k", F.row_number().over(W.partitionBy("repo_id", "at").orderBy(*order)))
        lists = materialize(places.filter(F.col("k") <= limit + 1).drop("k"))
    others = lists.filter("at <> node_id").withColumn("k", F.row_number().over(W.partitionBy("repo_id", "at").orderBy(*order)))
    return others.filter(F.col("k") <= limit).select("repo_id", F.col("at").alias("seed"), "node_id", "k").join(scoped(seeds_).select("repo_id", F.col("node_id").alias("seed")).distinct(), ["repo_id", "seed"], "left_semi")


def expand(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, impact_depth: int = 2, per_seed: int = PER_SEED,
           include=("test", "caller", "callee", "impacted", "related_config")) -> DataFrame:
    """(repo_id, node_id, reason, distance): neighbours of written seeds (repo_id, node_id, tags); seeds themselves aren't among them."""
    seeds_ = scoped(seeds_)
    near = {"test": find.tests_of, "caller": find.callers, "callee": find.callees}
    shape = lambda df, reason, d: df.select("repo_id", "seed", "node_id", F.lit(reason).alias("reason"), F.lit(d).alias("distance"), F.lit(0).cast("bigint").alias("ord"))
    # Written, the seeds' own edges are of known size: few are sent to the nodes, which aren't shuffled then.
    of_types = scoped(edges).filter(F.col("edge_type").isin("CALLS", "TESTED_BY")).select("repo_id", "edge_type", "src_id", "dst_id")
    own = [of_types.join(seeds_.select("repo_id", F.col("node_id").alias(end)), ["repo_id", end], "left_semi").select(*of_types.columns) for end in ("src_id", "dst_id")]
    close = materialize(own[0].unionByName(own[1])) if any(r in include for r in near) else None
    parts = [shape(near[r](nodes, close, seeds_).withColumnRenamed("anchor", "seed"), r, 1) for r in near if r in include]
    if "impacted" in include and impact_depth > 1:
        # As a query for one target would: the most important ones first.
        top = best_upstream(seeds_, nodes, edges, impact_depth, find.DEFAULT_LIMIT)
        parts.append(top.select("repo_id", "seed", "node_id", F.lit("impacted").alias("reason"), F.lit(2).alias("distance"), F.col("k").cast("bigint").alias("ord")))
    if "related_config" in include:
        configs = related_configs(seeds_, nodes)
        parts.append(configs.select("repo_id", "seed", "node_id", F.lit("related_config").alias("reason"), F.lit(2).alias("distance"), F.col("ord").cast("bigint").alias("ord")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return materialize(cap_and_merge(every, per_seed).join(seeds_.select(*ID), ID, "left_anti"))


def trim(blocks: DataFrame, budget: int, model: str, by: tuple[str, ...] = ()) -> DataFrame:
    """blocks (repo_id, node_id, reason, distance, score, chars) that are selected: all touched ones, others by score as they fit.

    by: columns that tell reviews apart, each with a budget of its own; rows without one are in none. A review's candidates pass through
    one task as a sorted stream of which nothing is held; texts don't travel with it.
    """
    blocks = scoped(blocks)
    others = F.col("reason") != "touched"
    name = F.concat_ws("\n", "node_id", "repo_id")
    sizes = blocks.select(*by, *ID, "chars", others.cast("int").alias("ord_1"), F.when(others, -F.col("score")).otherwise(0.0).alias("ord_2"), name.alias("ord_3"))
    taken = greedy_fit_stream(sizes, budget, model, by, ["ord_1", "ord_2", "ord_3"], always=F.col("ord_1") == 0, out=ID)
    return blocks.join(taken, [*by, *ID], "left_semi").select(*blocks.columns)


def packed_chars(n: Column, chars: Column) -> Column:
    return len(header("")) + chars + len(SEPARATOR) * F.greatest(n - 1, F.lit(0))

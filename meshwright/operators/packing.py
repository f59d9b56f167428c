"""Packing: blocks of text within a budget of characters, as a prefix or by greedy fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, most_chars

SEPARATOR = "\n\n---\n\n"
CHARS_PER_TOKEN = 3.5
LEAST_REMAINDER = 200
#: Parts of a partition that are cut by themselves.
SALTS = 64
TRUNCATED = "\n… [truncated]"


def header(query: str) -> str:
    return f"# Code Context\n**Query:** {query}\n\n" if query else "# Code Context\n\n"


def pack_prefix(blocks: DataFrame, max_tokens: int = 6000, query: str = "", order: str = "position", partition: tuple[str, ...] = ()) -> DataFrame:
    """(partition, position, block): the blocks that fit, in order (unique in a partition), up to the first that doesn't; that one is cut if enough room is left.

    A running sum per partition tells; only blocks within the budget leave the operator. Every block takes
    the separator at least, which bounds how many fit: a partition is first cut to as many, in salted
    parts and by length alone, so that no task holds all of a large one and no text is sorted.
    """
    budget = int(max_tokens * CHARS_PER_TOKEN) - len(header(query))
    sep = len(SEPARATOR)
    w = W.partitionBy(*partition).orderBy(order)
    if partition:
        most = max(1, budget // sep + 1)
        sizes = blocks.select(*partition, order, F.length("block").alias("_chars"))
        salted = W.partitionBy(*partition, F.pmod(F.xxhash64(order), F.lit(SALTS))).orderBy(order)
        first = sizes.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= most)
        used = first.withColumn("used", F.sum(F.col("_chars") + sep).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        near = used.filter(F.col("used") - F.col("_chars") - sep <= budget).select(*(F.col(c).alias(f"_k_{c}") for c in (*partition, order)), "used")
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*partition, order)]
        sized = blocks.join(near, same).drop(*(f"_k_{c}" for c in (*partition, order)))
    else:
        sized = blocks.withColumn("used", F.sum(F.length("block") + sep).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = F.col("used") - F.length("block") - sep
    room = budget - before - sep
    fits = F.col("used") <= budget
    # Sizes are positive, so the first that overflows is the only one whose predecessor still fits.
    cut = ~fits & (before <= budget) & (room > LEAST_REMAINDER)
    text = F.when(fits, F.col("block")).otherwise(F.concat(F.substring(F.col("block"), F.lit(1), room.cast("int")), F.lit(TRUNCATED)))
    return sized.filter(fits | cut).select(*partition, F.col(order), text.alias("block"))


def packed_text(blocks: DataFrame, query: str = "", order: str = "position") -> str:
    """Header and blocks as one text; blocks are few, since they were packed."""
    rows = blocks.select(order, "block").orderBy(order).collect()
    return header(query) + SEPARATOR.join(r.block for r in rows)


def greedy_fit(seeds_chars: Column, seeds_n: Column, candidates: Column, budget: Column | int, model: str) -> Column:
    """Ids of candidates (array of (ord, id, chars) in order) taken while the packed text stays within the budget.

    A candidate that doesn't fit is passed over and later ones may still fit, so this is a fold. Text
    length is the header, the blocks and a separator between any two.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("taken"))

    def step(state, c):
        n = seeds_n + state.n + 1
        total = len(header("")) + seeds_chars + state.chars + c.chars + len(SEPARATOR) * (n - 1)
        fits = estimate_tokens(total, model) <= budget
        return F.when(fits, F.struct((state.chars + c.chars).cast("bigint").alias("chars"), (state.n + 1).alias("n"), F.concat(state.taken, F.array(c.id)).alias("taken"))).otherwise(state)

    return F.aggregate(candidates, start, step, lambda s: s.taken)


def greedy_fit_stream(candidates: DataFrame, budget: int, model: str, by: tuple[str, ...], order: list[str], always: Column, out: list[str]) -> DataFrame:
    """(by, out): candidates (with chars) that are taken in order, each group within the budget; those for which always holds are taken anyhow.

    Each task reads its groups' rows sorted and carries the length and number of what it has taken from
    batch to batch, and from group to group none of it. So a group may have any number of rows. A group
    is folded in one task, since what fits hangs on all that was taken before.
    """
    most = most_chars(budget, model)
    head, sep = len(header("")), len(SEPARATOR)
    rows = candidates.select(*by, *out, F.col("chars").cast("bigint").alias("_chars"), always.alias("_always"), F.struct(*order).alias("_order"))
    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    schema = dealt.select(*by, *out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chars, n = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            kept = []
            for i, (key, size, sure) in enumerate(zip(keys, batch.column("_chars").to_pylist(), batch.column("_always").to_pylist())):
                if key != group:
                    group, chars, n = key, 0, 0
                if sure or head + chars + (size or 0) + sep * n <= most:
                    chars, n = chars + (size or 0), n + 1
                    kept.append(i)
            yield batch.select([*by, *out]).take(pa.array(kept, type=pa.int64()))

    return dealt.sortWithinPartitions(*by, "_order").drop("_order").mapInArrow(run, schema)


def greedy_fit_all(candidates: DataFrame, budget: int, model: str, chunk: int = 1000) -> DataFrame:
    """(id): what greedy_fit takes of candidates (ord, id, chars; ids unique), however many there are.

    A fold over sorted chunks that carries its state. What doesn't fit now never will, since room only
    shrinks; so a chunk is the next candidates that still fit, and its first one is always taken.
    """
    sizes = candidates.select("ord", "id", F.col("chars").cast("bigint").alias("chars"))
    chars, taken, rest = 0, [], sizes
    while True:
        total = F.lit(len(header("")) + chars + len(SEPARATOR) * len(taken)) + F.col("chars")
        ahead = rest.filter(estimate_tokens(total, model) <= budget).orderBy("ord", "id").limit(chunk)
        listed = ahead.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "chars"))).alias("l"))
        by_place = F.transform("l", lambda c, i: F.struct(c.ord.alias("ord"), i.cast("string").alias("id"), c.chars.alias("chars")))
        row = listed.select("l", greedy_fit(F.lit(chars), F.lit(len(taken)), by_place, budget, model).alias("places")).first()
        if not row.l:
            return candidates.sparkSession.createDataFrame(taken, candidates.select("id").schema)
        found = [row.l[int(i)] for i in row.places]
        chars += sum(c.chars for c in found)
        taken += [(c.id,) for c in found]
        last = row.l[-1]
        rest = sizes.filter((F.col("ord") > last.ord) | ((F.col("ord") == last.ord) & (F.col("id") > last.id)))

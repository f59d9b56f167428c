"""Intervals of whole numbers by cells of powers of four: the least of what overlaps, without its pairs.

An interval overlaps another if it begins within it, or holds its first place. Both questions are asked
of cells: a place lies in one cell of each level, an interval is covered by a few cells of each level
up to its length. So what begins within is found where covering cells of the one meet cells of the
other's first place, and what holds a place where it is the other way round. Each cell keeps the least
of its rows, so rows grow with the intervals times the logarithm of their length, however many overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels up to which cells are told; four to their number is beyond any int.
LEVELS = 16
_BEGINS, _HOLDS = 0, 1


def _cell(level, number: Column) -> Column:
    return F.lit(level).cast("bigint") * (1 << 40) + number if isinstance(level, int) else level.cast("bigint") * (1 << 40) + number


def cells_of(place: Column) -> Column:
    """The cell of each level that a place (0 or more) is in, as an array of longs."""
    return F.array(*(_cell(level, F.shiftright(place.cast("bigint"), 2 * level)) for level in range(LEVELS)))


def cover(low: Column, high: Column) -> Column:
    """The fewest cells that together are low .. high, as an array of longs; none if high is below low."""
    start = F.struct(low.cast("bigint").alias("a"), high.cast("bigint").alias("z"), F.array().cast("array<bigint>").alias("cells"))

    def step(s, level):
        # What is left of the first cell of the next level, and right of the last one.
        left = F.least(s.z + 1, s.a + F.pmod(4 - F.pmod(s.a, F.lit(4)), F.lit(4)))
        right = F.greatest(left, s.z + 1 - F.pmod(s.z + 1, F.lit(4)))
        run = lambda a, z: F.when(a < z, F.transform(F.sequence(a, F.greatest(a, z - 1)), lambda c: _cell(level, c))).otherwise(F.array().cast("array<bigint>"))
        more = F.struct(F.shiftright(left, 2).alias("a"), (F.shiftright(right, 2) - 1).alias("z"), F.concat(s.cells, run(s.a, left), run(right, s.z + 1)).alias("cells"))
        return F.when(s.a <= s.z, more).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda s: s.cells)


def _kept(kind: int, cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("cell")))


def least_overlapping(probes: DataFrame, intervals: DataFrame, group: str, probe_id: str, best: str) -> DataFrame:
    """(probe_id, best): for each probe (probe_id, group, low, high) the least best of the intervals (group, low, high, best) of its group that overlap it.

    Bounds are 0 or more, high isn't below low. Probes that nothing overlaps have no row.
    """
    # Of those that span the same places the least one is enough.
    spans = intervals.groupBy(group, "low", "high").agg(F.min(best).alias(best))
    held = spans.select(group, F.explode(F.concat(_kept(_BEGINS, cells_of(F.col("low"))), _kept(_HOLDS, cover(F.col("low"), F.col("high"))))).alias("c"), best)
    least = held.groupBy(group, "c.kind", "c.cell").agg(F.min(best).alias(best))
    asked = probes.select(probe_id, group, F.explode(F.concat(_kept(_BEGINS, cover(F.col("low"), F.col("high"))), _kept(_HOLDS, cells_of(F.col("low"))))).alias("c")).select(probe_id, group, "c.kind", "c.cell")
    return asked.join(least, [group, "kind", "cell"]).groupBy(probe_id).agg(F.min(best).alias(best))

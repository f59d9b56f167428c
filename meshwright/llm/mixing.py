"""Mixing sources to target weights, DataFrame functions only.

A golden-ratio sequence is mapped through the cumulative target shares: slot n belongs to the
source whose share holds the fractional part of n times the golden ratio. Slots are ranked within
their source and joined with that source's equal-word blocks, cut from its documents in shuffled
order. A source whose target exceeds its size is walked through again, three times at most.

Defined results: a null text has size 0; a null source is a source of its own, ordered last. Rows
that repeat an id are documents of their own. Documents of size 0 are taken 0 words. If all sizes
are 0, so are all targets. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which slots find their source with an equality join.
CELLS = 1024
#: Documents of one bucket of the shuffled order, and slots of one ranking chunk.
BUCKET_ROWS = 4096
#: Words of a block, which one slot takes.
BLOCK_WORDS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_parts(df: DataFrame, order: Column, rows: int) -> DataFrame:
    """df with part: range partitions in that order, kept as written, so that order can be restored part by part."""
    return materialize(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), rows)


def before_each(df: DataFrame, value: Column, order: Column, out: str) -> DataFrame:
    """df (with part) with the sum of value over all rows before each one in order.

    Sums of parts, one row a part, give where a part starts; a window within the part does the rest.
    """
    sums = df.groupBy("part").agg(F.sum(value).alias("_sum"))
    starts = sums.select("part", F.coalesce(F.sum("_sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(starts, "part").withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def water_level(sources: DataFrame) -> float:
    """The level at which targets (the level times weight, cap at most) sum to the total of sizes.

    Raising the level caps more sources, which raises it again, until no more are capped: a scalar
    aggregation a round, as in resharing the excess.
    """
    total, weights = sources.agg(F.sum(F.col("source_size").cast("double")), F.sum("w")).first()
    level, capped = (total or 0.0) / (weights or 1.0), -1
    while True:
        over = F.col("cap") <= level * F.col("w")
        row = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("w")))).first()
        if row[0] == capped or not row[2]:
            return level
        capped, level = row[0], (total - row[1]) / row[2]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int, int]:
    """(src, source, source_size, target, quota, lo, hi): one row per source, src its rank by code point; the rows and words of all."""
    order = F.asc_nulls_last("source")
    summed = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), sizes.count())
    n_rows, words, rows = summed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    src = before_each(in_parts(summed.drop("n"), order, rows), F.lit(1), order, "src")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("double")
    weighted = materialize(src.withColumn("src", F.col("src").cast("int")).withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")), rows)
    filled = weighted.withColumn("target", F.least("cap", F.lit(water_level(weighted)) * F.col("w")))
    total = filled.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    placed = before_each(filled, F.col("target"), F.asc("src"), "below")
    share = lambda c: F.lit(None).cast("double") if not total else c / total
    shares = placed.select(
        "src", "source", "source_size", "target", F.round("target").cast("bigint").alias("quota"),
        share(F.col("below")).alias("lo"), share(F.col("below") + F.col("target")).alias("hi"),
    )
    return materialize(shares, rows), n_rows, words


def golden_slots(spark, n_slots: int, sources: DataFrame) -> DataFrame:
    """(src, rank, slot): the low-discrepancy schedule, ranked within each source.

    Ranks come from counts per chunk of slots and a rank within the chunk, so that a source with most
    of the slots is ranked in parallel.
    """
    x = F.col("slot") * GOLDEN
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    spans = sources.filter("hi > lo").select(
        "src", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int")))).alias("cell"),
    )
    dealt = points.join(spans, "cell").filter("x >= lo and x < hi").select("src", "slot", F.floor(F.col("slot") / BUCKET_ROWS).alias("chunk"))
    counts = dealt.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    ahead = counts.select("src", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = dealt.withColumn("nth", F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot")) - 1)
    return within.join(ahead, ["src", "chunk"]).select("src", (F.col("ahead") + F.col("nth")).alias("rank"), "slot")


def shuffled_stream(sizes: DataFrame, sources: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """sizes with src, bucket, nth and start: each document's place in its source's shuffled stream of words.

    Order is by a 60-bit hash of seed and id, then the id, the size, and a hash of the whole row, so that
    equal ids with different texts fall alike in each run. Sums per hash bucket give where a bucket starts;
    within a bucket, which holds about BUCKET_ROWS documents, a running sum does the rest.
    """
    bits = max(0, (max(1, n_rows) // BUCKET_ROWS).bit_length())
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    bucket = F.shiftright("u", 60 - bits)
    keyed = (
        sizes.withColumn("u", hashed)
        .withColumn("bucket", bucket)
        .join(sources.select(F.col("source").alias("s"), "src", "source_size", "target", "quota"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
    )
    order = W.partitionBy("src", "bucket").orderBy("u", "doc_id", "size", "row")
    placed = materialize(
        keyed.withColumn("nth", F.row_number().over(order))
        .withColumn("inside", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("u", "row"),
        n_rows,
    )
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    ahead = sums.select("src", "bucket", F.coalesce(F.sum("sum").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return placed.join(ahead, ["src", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside"))


def fragments(stream: DataFrame, block_words: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """stream's rows cut at block borders, once per pass: (.., epoch, rank, words) for what the quota covers.

    A row that the quota doesn't cover stays as one without epoch, rank and words.
    """
    cut = lambda e: (e * F.col("source_size") + F.col("start"), F.least(e * F.col("source_size") + F.col("start") + F.col("size"), F.col("quota")))
    block = lambda x: F.floor(x / block_words)
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(e.alias("epoch"), cut(e)[0].alias("a"), cut(e)[1].alias("z"))), lambda p: p.a < p.z)
    blocks = F.transform(F.col("p"), lambda p: F.transform(F.sequence(block(p.a), block(p.z - 1)), lambda r: F.struct(p.epoch.alias("epoch"), p.a.alias("a"), p.z.alias("z"), r.alias("rank"))))
    dealt = stream.withColumn("p", passes).withColumn("f", F.explode_outer(F.flatten(blocks))).drop("p")
    words = F.least(F.col("f.z"), (F.col("f.rank") + 1) * block_words) - F.greatest(F.col("f.a"), F.col("f.rank") * block_words)
    return dealt.withColumns({"epoch": F.col("f.epoch"), "rank": F.col("f.rank"), "words": words}).drop("f")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
        weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies, first_slot): one row per document.

    taken is the number of words that the schedule takes, repeats counted; copies is in how many
    passes it takes the document's middle; first_slot is the earliest slot that holds a part of it.
    Blocks that no slot reaches (a few per source, the sequence's discrepancy) follow behind the last
    slot. carry names further columns of docs to keep.
    """
    spark = docs.sparkSession
    row = F.xxhash64(*(F.col(c) for c in docs.columns))
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("row"), *carry))
    sources, n_rows, total = source_targets(sizes, weights)
    n_slots = -(-total // block_words)
    stream = shuffled_stream(sizes, sources, n_rows, seed)
    slots = golden_slots(spark, n_slots, sources)
    middle = F.col("epoch") * F.col("source_size") + F.col("start") + F.floor(F.col("size") / 2)
    mid = ((F.floor(middle / block_words) == F.col("rank")) & (middle < F.col("quota"))).cast("int")
    kept = ["doc_id", "size", "source", "source_size", "target", *carry]
    slot = F.when(F.col("rank").isNotNull(), F.coalesce("slot", n_slots + F.col("rank")))
    return (
        fragments(stream, block_words).select(*kept, "src", "bucket", "nth", "rank", "words", mid.alias("mid"))
        .join(slots, ["src", "rank"], "left")
        .groupBy("src", "bucket", "nth", *kept)
        .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.coalesce(F.sum("mid"), F.lit(0)).cast("int").alias("copies"), F.min(slot).alias("first_slot"))
        .select("doc_id", "size", "source", "source_size", "target", "taken", "copies", "first_slot", *carry)
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix has them: each row as often as the schedule passes its middle, so three times at most.

    Rows equal in all columns share a name, and their copies are summed.
    """
    key = ["__k_id", "__k_row"]
    named = docs.withColumns({key[0]: F.coalesce(F.col(id_col), F.lit(0).cast("bigint")), key[1]: F.xxhash64(F.col(id_col).isNull(), *map(F.col, docs.columns))})
    mixed = mix(named, id_col, text_col, source_col, carry=tuple(key), **options)
    times = mixed.filter("copies > 0").groupBy(*key).agg(F.sum("copies").cast("int").alias("__copies"))
    rows = named.join(times, key).dropDuplicates(key)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)

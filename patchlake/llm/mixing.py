"""Mixing sources to target weights with a low-discrepancy schedule.

The words of every source, documents in a shuffled order, are cut into blocks
of equal length. Slot k of the schedule takes the point k * golden ratio mod 1
and goes to the source whose interval of cumulative weights holds the point;
the r-th slot of a source takes its block r, starting again after the last. So
every stretch of the schedule has the target mix, and a document is taken as
often as its blocks are. All points are integers below 2^30, so that reruns and
other engines agree to the last slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.llm.common import WHITE, keep

# Blocks hold at most so many words; a source has at least LEAST_BLOCKS of them (or one a word).
BLOCK_WORDS = 256
LEAST_BLOCKS = 512
MAX_REPEATS = 3
# 2^30 divided by the golden ratio, made odd: every point comes once in 2^30 slots.
_POINTS = 1 << 30
GOLDEN = 663608941
# Points are looked up among the intervals of their cell.
_CELL = 1 << 18
_CHUNK = 1 << 16
_SLICE_DIGITS = 3
_BLOCK_OF = (
    "case when {word} < longer * (words + 1) then {word} div (words + 1)"
    " else longer + ({word} - longer * (words + 1)) div words end"
)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again. They
    share the sum of all sizes by weight, but none gets more than three times
    its own size; what it cannot take is shared among the others. The limit
    rises with size / weight, so sources at their limit come first in that order.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    by_limit = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    # Were all sources up to this one at their limit, the level of the rest would still exceed its own.
    weighed = (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % MAX_REPEATS + 1).cast("bigint"))
        .withColumn("limit", F.col("source_size") * MAX_REPEATS)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("used", F.coalesce(F.sum("limit").over(earlier), F.lit(0)))
        .withColumn("used_weight", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn(
            "full", F.col("limit") * (F.col("all_weight") - F.col("used_weight")) <= (F.col("total") - F.col("used")) * F.col("weight")
        )
        .withColumn("full_sum", F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every))
        .withColumn("full_weight", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every))
    )
    shared = (F.col("total") - F.col("full_sum")) * F.col("weight").cast("double") / F.nullif(F.col("all_weight") - F.col("full_weight"), F.lit(0))
    return weighed.select(
        "source", "source_size", "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target")
    )


def schedule(sources: DataFrame) -> DataFrame:
    """(source, block, uses): how often the schedule takes each block.

    ``sources`` has one row per source (source, n_blocks, n_slots). Slots are
    made where they are used, in chunks; a slot's rank within its source is its
    rank in the chunk plus the source's slots in earlier chunks.
    """
    spark = sources.sparkSession
    every = Window.partitionBy(F.lit(0))
    running = every.orderBy(F.col("source").asc_nulls_last())
    lanes = sources.where("n_slots > 0").select(
        "source",
        "n_blocks",
        "n_slots",
        F.sum("n_slots").over(running).alias("high"),
        F.sum("n_slots").over(every).alias("all_slots"),
    )
    # An interval of the points for each source, in proportion to its slots; one row for each cell it reaches into.
    edge = f"bigint((cast({{}} as decimal(38,0)) * {_POINTS}) div all_slots)"
    lanes = (
        lanes.select(
            F.struct("source").alias("key"),
            "n_blocks",
            "all_slots",
            F.expr(edge.format("(high - n_slots)")).alias("from_point"),
            F.expr(edge.format("high")).alias("to_point"),
        )
        .where("from_point < to_point")
        .withColumn("cell", F.explode(F.expr(f"sequence(from_point div {_CELL}, (to_point - 1) div {_CELL})")))
    )
    total = lanes.agg(F.max("all_slots")).first()[0] or 0
    point = F.pmod(F.pmod("id", F.lit(_POINTS)) * GOLDEN, F.lit(_POINTS))
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"))
    dealt = (
        slots.withColumn("cell", F.expr(f"point div {_CELL}"))
        .join(lanes.drop("all_slots"), "cell")
        .where("point >= from_point and point < to_point")
        .select("key", "n_blocks", "slot", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    )
    counts = dealt.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "chunk").orderBy("slot")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["key", "chunk"])
    rank = F.col("before") + F.col("inside")
    return (
        ranked.where(rank < MAX_REPEATS * F.col("n_blocks"))
        .groupBy("key", F.pmod(rank, F.col("n_blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row, repeated ones too.

    ``size`` counts words; null and empty texts have none and are never taken.
    Documents of a source are ordered by the MD5 of their id (then id, size): a
    reproducible shuffle. A null source is a source of its own. ``taken`` counts
    words with their repeats and is at most three times the size; a source's
    sum is its target up to the words of two or three blocks.
    """
    rows = keep(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
        ).select("*", F.struct("source").alias("key"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash")),
        "sizes",
    ).withColumn("slice", F.substring("hash", 1, _SLICE_DIGITS))
    slices = keep(rows.groupBy("key", "slice").agg(F.sum("size").alias("words")), "slices")
    sizes = slices.groupBy("key").agg(F.sum("words").alias("source_size")).select("key.source", "source_size")
    # As many slots as blocks of the source's length fill its target.
    blocks = F.least("source_size", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block_words)))
    sources = keep(
        targets(sizes)
        .withColumn("n_blocks", blocks.cast("bigint"))
        .withColumn("n_slots", F.coalesce(F.round(F.col("target") * F.col("n_blocks") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("bigint")),
        "sources",
    )
    uses = keep(schedule(sources.select("source", "n_blocks", "n_slots")), "uses")
    facts = sources.select(F.struct("source").alias("key"), "source_size", "target", "n_blocks")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("key", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside))
        .withColumn("row", F.monotonically_increasing_id())
        .join(offsets, ["key", "slice"])
        .join(facts, "key")
        .withColumn("end", F.col("before") + F.col("upto"))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    placed = keep(placed.select("row", "doc_id", "key", "size", "source_size", "target", "n_blocks", "start", "end"), "placed")
    # The first (source_size mod n_blocks) blocks have one word more than the others.
    parts = (
        placed.where("size > 0")
        .withColumn("words", F.expr("source_size div n_blocks"))
        .withColumn("longer", F.expr("source_size % n_blocks"))
        .withColumn("first", F.expr(_BLOCK_OF.format(word="start")))
        .withColumn("last", F.expr(_BLOCK_OF.format(word="(end - 1)")))
        .withColumn("block", F.explode(F.sequence("first", "last")))
    )
    bound = lambda block: block * F.col("words") + F.least(block, F.col("longer"))
    overlap = F.least("end", bound(F.col("block") + 1)) - F.greatest("start", bound(F.col("block")))
    taken = (
        parts.select("row", "key", "block", overlap.alias("part"))
        .join(uses, ["key", "block"])
        .groupBy("row")
        .agg(F.sum(F.col("part") * F.col("uses")).alias("taken"))
    )
    return placed.join(taken, "row", "left").select(
        "doc_id", "key.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )

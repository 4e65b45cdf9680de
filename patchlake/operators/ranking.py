"""Exact ranks that do not put a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.session import cut_lineage

# Partition number and position inside it, as packed by the built-in id.
_POSITION_BITS = 33


def shuffle_key(seed: int, *ids: Column | str) -> Column:
    """A reproducible stand-in for a seeded shuffle: order rows by this hash."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def hash_ranks(
    df: DataFrame,
    groups: list[str],
    order_hash: Column,
    ties: list[str],
    rank: str = "rank",
    size: str = "group_size",
    digits: int = 3,
) -> DataFrame:
    """1-based rank by ``order_hash`` inside each group, and the group size.

    The leading hex digits of the hash cut every group into even slices
    (4,096 with three digits). Rows are ranked inside their slice; the number of
    rows in earlier slices comes from a count that is combined before the
    shuffle. A group of any size is thus spread over all tasks.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    keyed = df.withColumns(
        {
            **{k: F.struct(F.col(g)) for k, g in zip(keys, groups)},
            "__hash": order_hash,
        }
    ).withColumn("__slice", F.substring("__hash", 1, digits))
    counts = keyed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    per_group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = per_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "__slice",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(per_group).alias(size),
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy("__hash", *ties)
    ranked = keyed.withColumn("__inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "__slice"])
        .withColumn(rank, (F.col("__before") + F.col("__inside")).cast("bigint"))
        .drop(*keys, "__hash", "__slice", "__before", "__inside")
    )


def sorted_ranks(keys: DataFrame, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """0-based position of every row in the total order ``order``.

    A range-partitioned sort numbers rows inside each partition; the rows of
    earlier partitions are added from one count per partition. The numbered
    table is written out first, since both steps must see the same sort. The
    broadcast side has one row per sort partition. Pass narrow rows.
    """
    numbered = cut_lineage(keys.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", _POSITION_BITS).alias("__part")
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(rank, F.col("__before") + inside)
        .drop("__id", "__part", "__before")
    )

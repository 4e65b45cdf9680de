"""Shards by balanced label propagation.

Documents start in shards dealt out evenly. In each round every linked document
wishes to go to the shard where most of its group is, ties by a hash of the
group. A quota for each pair of shards admits moves that leave all counts as
they are: facing wishes swap, wishes around a ring of shards move on together,
and for the rest unlinked documents or whole small groups go the other way.
Rounds go on until no wish is left or none can be admitted; every admitted move
joins a document to most of its group, so they end. Counts stay at most one
apart. Links are equal texts. The label of a document only depends on counts
per (group, shard), so a round is two joins on narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake.llm.common import keep
from patchlake.operators.ranking import hash_ranks

SHARDS = 8
# Groups of at most so many rows may be moved whole to make room for others.
SMALL_GROUP = 64


def _dealt(ranked: DataFrame, rank: Column, plan: dict[tuple, list[tuple[int, int]]], keys: list[str]) -> Column:
    """The shard that ``plan`` gives to 1-based ``rank``: per key a list of (shard, how many), in that order."""
    choice = F.lit(None).cast("int")
    for key, shares in plan.items():
        upto = 0
        cases = F.lit(None).cast("int")
        bounds = []
        for shard, n in shares:
            upto += n
            bounds.append((upto, shard))
        for high, shard in reversed(bounds):
            cases = F.when(rank <= high, F.lit(shard)).otherwise(cases)
        hit = F.lit(True)
        for name, value in zip(keys, key):
            hit = hit & (F.col(name) == value)
        choice = F.when(hit, cases).otherwise(choice)
    return choice


def _ring(left: dict[tuple[int, int], int]) -> list[tuple[int, int]] | None:
    """A ring of shards along which wishes are left, if there is one."""
    ways: dict[int, list[int]] = {}
    for (s, t), n in sorted(left.items()):
        if n:
            ways.setdefault(s, []).append(t)
    done: set[int] = set()
    for start in sorted(ways):
        path, todo = [], [(start, iter(ways[start]))]
        while todo:
            node, rest = todo[-1]
            if len(path) < len(todo):
                path.append(node)
            step = next((t for t in rest if t not in done), None)
            if step is None:
                done.add(node)
                todo.pop()
                path.pop()
            elif step in path:
                ring = path[path.index(step) :]
                return list(zip(ring, [*ring[1:], step]))
            else:
                todo.append((step, iter(ways.get(step, []))))
    return None


def _quotas(
    wishes: dict[tuple[int, int], int], free: dict[int, int], settled: dict[tuple[int, int], int]
) -> tuple[dict, dict, dict]:
    """Admitted moves (from, to) -> count, and what goes back for them: unlinked documents (from, to) -> count, and
    whole groups (from, size) -> [(to, number of groups)].

    ``free`` counts unlinked documents by shard, ``settled`` groups by (shard,
    size). Every shard gives exactly as many documents as it gets.
    """
    admitted = {(s, t): min(n, wishes.get((t, s), 0)) for (s, t), n in wishes.items()}
    left = {k: n - admitted[k] for k, n in wishes.items()}

    def admit(edge: tuple[int, int], n: int) -> None:
        admitted[edge] += n
        left[edge] -= n

    while (ring := _ring(left)) is not None:
        n = min(left[edge] for edge in ring)
        for edge in ring:
            admit(edge, n)
    back: dict[tuple[int, int], int] = {}
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    free, settled = dict(free), dict(settled)
    for s, t in sorted(left):
        n = min(left[s, t], free.get(t, 0))
        if n:
            admit((s, t), n)
            back[t, s] = n
            free[t] -= n
        for shard_, size in sorted((k for k in settled if k[0] == t), key=lambda k: -k[1]):
            number = min(settled[shard_, size], left[s, t] // size)
            if number:
                admit((s, t), number * size)
                groups.setdefault((t, size), []).append((s, number))
                settled[shard_, size] -= number
    return admitted, back, groups


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, n_cut) for every row, repeated ones too.

    ``size`` is the UTF-8 length of the text plus 1; a null text has no bytes, a
    group of its own and CRC 0. Shard sizes are at most one row apart. ``slot``
    counts from 0 without gaps within a shard. ``n_cut`` is the number of rows of
    the same text outside the row's shard. A group larger than a shard is spread
    over several. The driver sees counts per shard, per pair of shards, and of
    small groups per shard and size.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(F.col(text), 256)).alias("text_key"),
    )
    base = keep(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("row").cast("string")))
    ranked = hash_ranks(base.select("row", "doc_id", "text_key"), [], order, ["row"])
    groups = base.groupBy("text_key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    total = base.count()
    part_rows = max(1, total // shards)
    parts = F.ceil(F.col("members") / part_rows)
    part = F.pmod(F.xxhash64("row"), parts)
    keyed = keep(
        ranked.select("row", "text_key", F.pmod(F.col("rank") - 1, F.lit(shards)).cast("int").alias("shard"))
        .join(keep(groups, "groups"), "text_key", "left")
        .select("row", "shard", F.when(F.col("members") > 1, F.concat_ws(":", "text_key", part.cast("string"))).alias("unit")),
        "shards",
    )
    by_hash = F.md5(F.col("row").cast("string"))
    while True:
        linked, singles = keyed.where("unit is not null"), keyed.where("unit is null")
        per_shard = linked.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"))
        tie = F.xxhash64("unit", "shard")
        best = keep(
            per_shard.groupBy("unit").agg(
                F.max_by("shard", F.struct("n", tie.alias("tie"))).alias("wish"), F.sum("n").alias("size"), F.max("n").alias("most")
            ),
            "wishes",
        )
        wishing = keep(linked.join(best.select("unit", "wish"), "unit"), "wishes")
        moving = wishing.where("wish <> shard")
        wishes = {(r[0], r[1]): r[2] for r in moving.groupBy("shard", "wish").count().collect()}
        free = {r[0]: r[1] for r in singles.groupBy("shard").count().collect()}
        whole = best.where((F.col("most") == F.col("size")) & (F.col("size") <= SMALL_GROUP)).withColumnRenamed("wish", "shard")
        settled = {(r[0], r[1]): r[2] for r in whole.groupBy("shard", "size").count().collect()} if wishes else {}
        admitted, back, groups = _quotas(wishes, free, settled)
        if not any(admitted.values()):
            break
        go = {(s, t): [(t, n)] for (s, t), n in admitted.items() if n}
        movers = hash_ranks(moving, ["shard", "wish"], by_hash, ["row"])
        moved = movers.withColumn("to", _dealt(movers, F.col("rank"), go, ["shard", "wish"]))
        ways: dict[tuple, list[tuple[int, int]]] = {}
        for (s, t), n in sorted(back.items()):
            ways.setdefault((s,), []).append((t, n))
        ranked_singles = hash_ranks(singles, ["shard"], by_hash, ["row"])
        returned = ranked_singles.withColumn("to", _dealt(ranked_singles, F.col("rank"), ways, ["shard"]))
        stays = wishing.where("wish = shard").select("row", "shard", "unit")
        if groups:
            units = hash_ranks(whole.select("unit", "shard", "size"), ["shard", "size"], F.md5("unit"), ["unit"])
            sent = keep(units.select("unit", _dealt(units, F.col("rank"), groups, ["shard", "size"]).alias("to")).where("to is not null"), "groups")
            stays = stays.join(sent, "unit", "left").select("row", F.coalesce("to", "shard").alias("shard"), "unit")
        columns = ["row", F.coalesce("to", "shard").alias("shard"), "unit"]
        keyed = keep(moved.select(*columns).unionAll(returned.select(*columns)).unionAll(stays), "shards")
    slots = hash_ranks(keyed.select("row", "shard"), ["shard"], F.md5(F.col("row").cast("string")), ["row"])
    placed = keep(base.join(slots.select("row", "shard", (F.col("rank") - 1).alias("slot")), "row"), "placed")
    inside = keep(placed.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("here")), "inside")
    outside = keep(
        inside.groupBy("text_key").agg(F.sum("here").alias("members")).where("members > 1").join(inside, "text_key"), "inside"
    )
    cut = F.coalesce(F.col("members") - F.col("here"), F.lit(0)).alias("n_cut")
    return placed.join(outside, ["text_key", "shard"], "left").select(
        "doc_id", "size", "text_crc32", "shard", "slot", cut
    )

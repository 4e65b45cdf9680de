"""First-come dedup over one key or over two keys at once."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from patchlake.session import discard, stored


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows with no key are all kept.

    The rank filter reaches the window, so every map task sends at most one row
    per key and a key with many copies does not fill one task.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    unkeyed = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")
    return keyed.withColumn("__first", first).filter("__first = 1").drop("__first").unionByName(unkeyed)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a, b) of integers.

    Nodes hook to their smallest neighbour, the chains of hooks are halved until
    every node points at a root, and the edges are contracted to the roots. Each
    repeat leaves at most half of the nodes of every component. Steps are stored
    tables of known size: a checkpoint hands on the estimate of its plan, which a
    join of a table with itself squares, and over the repeats of a long chain that
    number grows to millions of digits.
    """
    live = stored(edges.filter("a <> b").distinct(), "live")
    found = stored(edges.select("a").unionAll(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "found")
    while not live.isEmpty():
        ends = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parent")
        while True:
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = stored(parent.join(above, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parent")
            discard(parent)
            parent = jumped
            if parent.filter("moved").isEmpty():
                break
        roots = parent.select(F.col("a").alias("component"), "p")
        named = stored(found.join(roots, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "found")
        left, right = (parent.select(F.col("a").alias(end), F.col("p").alias(f"root_{end}")) for end in ("a", "b"))
        merged = stored(
            live.join(left, "a").join(right, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "live"
        )
        discard(found, parent, live)
        found, live = named, merged
    return found


def _sequential_pass(rows: pd.DataFrame) -> pd.DataFrame:
    """What a pass in order keeps of one component."""
    seen_a, seen_b, kept = set(), set(), []
    for order_key, key_a, key_b in rows.sort_values("order_key")[["order_key", "key_a", "key_b"]].itertuples(index=False):
        if key_a not in seen_a and key_b not in seen_b:
            seen_a.add(key_a)
            seen_b.add(key_b)
            kept.append(order_key)
    return pd.DataFrame({"order_key": pd.Series(kept, dtype=rows["order_key"].dtype)})


def first_per_two_keys(keys: DataFrame, rounds: int = 6, component_rows: int = 200_000) -> DataFrame:
    """Order keys that a sequential pass would keep.

    ``keys`` has order_key (unique), key_a and key_b. The pass keeps a row if no
    earlier kept row has its key_a or its key_b. Rows that come first under both
    of their keys are surely kept, and every other row that shares a key with
    one of them is surely dropped; what is left goes to the next round. Only
    narrow rows move, all minima combine before the shuffle, and each round is
    written out so that a lost executor costs one round.

    What is left after ``rounds`` rounds are chains, where a round settles few
    rows. Rows are then grouped by the components of their keys; a component of at
    most ``component_rows`` rows is finished by one pass in a task, a larger one
    goes on with rounds. Results depend on neither number. Nodes are hashes of
    the keys: if two meet, components merge, and the pass compares the keys
    themselves.
    """
    # Copies under both keys can never be kept, so they leave before the rounds.
    open_rows = stored(keys.groupBy("key_a", "key_b").agg(F.min("order_key").alias("order_key")), "open")
    kept = []
    while True:
        for _ in range(rounds):
            chosen, left = _round(open_rows)
            discard(open_rows)
            open_rows = left
            kept.append(chosen.select("order_key"))
            if open_rows.isEmpty():
                return _union(kept)
        nodes = open_rows.withColumns({"a": F.xxhash64(F.lit("a"), "key_a"), "b": F.xxhash64(F.lit("b"), "key_b")})
        found = components(nodes.select("a", "b"))
        grouped = stored(nodes.join(found, F.col("a") == F.col("node")).drop("a", "b", "node"), "grouped")
        discard(found, open_rows)
        small = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= component_rows).select("component")
        schema = StructType([open_rows.schema["order_key"]])
        kept.append(grouped.join(small, "component", "left_semi").groupBy("component").applyInPandas(_sequential_pass, schema))
        kept = [stored(_union(kept), "kept")]
        open_rows = stored(grouped.join(small, "component", "left_anti").drop("component"), "open")
        discard(grouped)
        if open_rows.isEmpty():
            return kept[0]


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _round(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are first under both keys, and the rows that share no key with one of them."""
    first_a = open_rows.groupBy("key_a").agg(F.min("order_key").alias("first_a"))
    first_b = open_rows.groupBy("key_b").agg(F.min("order_key").alias("first_b"))
    marked = stored(
        open_rows.join(first_a, "key_a")
        .join(first_b, "key_b")
        .withColumn("keep", (F.col("order_key") == F.col("first_a")) & (F.col("order_key") == F.col("first_b")))
        .drop("first_a", "first_b"),
        "marked",
    )
    chosen = marked.filter("keep").drop("keep")
    rest = marked.filter("not keep").drop("keep")
    left = stored(rest.join(chosen.select("key_a"), "key_a", "left_anti").join(chosen.select("key_b"), "key_b", "left_anti"), "open")
    return chosen, left

"""Centroid clustering with a vantage-point tree over the centroids.

Each round the driver builds the tree from the k centroids and broadcasts it; a
vector finds its nearest centroid by best-first branch and bound. A node holds
one centroid and splits the others at the median of their distances to it; a
subtree's lower bound follows from the triangle inequality. A node is visited
unless its bound lies beyond the best distance, the radius itself included, so
that a tie with a smaller number is never missed. Bounds are doubles with a
margin, distances are exact integers. All vectors of a batch walk the tree
together, each in its own order.

Vectors stay where they are stored. Of a round only sums and counts per centroid
come back, added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.llm.common import keep

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
# Larger integers after scaling take this value.
LARGEST = 1 << 53
# Below this size of the components, 64-bit integers hold a distance of a million components.
_SMALL = 1 << 20
# Part of a distance by which a rounded bound may be wrong.
_MARGIN = 1e-9
_LONG = 2**63 - 1
_BATCH = 2048


@dataclass
class Tree:
    """A vantage-point tree: node i holds centroid ``number[i]``; children are nodes or -1."""

    centroids: np.ndarray
    number: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    # Least and largest distance from the node's centroid to those of each child.
    inner_range: np.ndarray
    outer_range: np.ndarray


def distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances, as int64 where they fit and else as Python integers."""
    if vectors.size == 0:
        return np.zeros(len(vectors), dtype=np.int64)
    if max(int(np.abs(vectors).max()), int(np.abs(centroid).max())) < _SMALL:
        difference = vectors - centroid
        return (difference * difference).sum(axis=1)
    wide = vectors.astype(object) - centroid.astype(object)
    return (wide * wide).sum(axis=1)


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def build_tree(centroids: np.ndarray) -> Tree:
    """The tree over all rows of ``centroids``; equal ones are nodes of their own."""
    k = len(centroids)
    tree = Tree(
        centroids, np.zeros(k, dtype=np.int64), np.full(k, -1), np.full(k, -1), np.zeros((k, 2)), np.zeros((k, 2))
    )
    made = 0
    todo = [(np.arange(k), None, 0)]
    while todo:
        members, parent, side = todo.pop()
        node, made = made, made + 1
        if parent is not None:
            (tree.inner if side == 0 else tree.outer)[parent] = node
        tree.number[node], rest = members[0], members[1:]
        if not len(rest):
            continue
        away = _roots(distances(centroids[rest], centroids[members[0]]))
        order = np.argsort(away, kind="stable")
        half = (len(rest) + 1) // 2
        for side, part, ranges in ((0, order[:half], tree.inner_range), (1, order[half:], tree.outer_range)):
            if len(part):
                ranges[node] = away[part].min(), away[part].max()
                todo.append((np.sort(rest[part]), node, side))
    return tree


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, the smallest number of equally near ones, and its squared distance."""
    n, k = len(vectors), len(tree.number)
    small = max(int(np.abs(vectors).max(initial=0)), int(np.abs(tree.centroids).max(initial=0))) < _SMALL
    best = np.full(n, _LONG if small else None, dtype=np.int64 if small else object)
    if not small:
        best[:] = 1 << 200
    number = np.full(n, k, dtype=np.int64)
    radius = np.full(n, np.inf)
    bound = np.full((n, k), np.inf)
    bound[:, 0] = 0
    active = np.arange(n)
    while len(active):
        node = bound[active].argmin(axis=1)
        low = bound[active, node]
        # Inclusive: a centroid at exactly the best distance may have a smaller number.
        going = np.isfinite(low) & (low <= radius[active] * (1 + _MARGIN))
        active, node, low = active[going], node[going], low[going]
        bound[active, node] = np.inf
        for at in np.unique(node):
            here = node == at
            rows, under = active[here], low[here]
            squared = distances(vectors[rows], tree.centroids[tree.number[at]])
            closer = (squared < best[rows]) | ((squared == best[rows]) & (tree.number[at] < number[rows]))
            closer = closer.astype(bool)
            best[rows[closer]], number[rows[closer]] = squared[closer], tree.number[at]
            away = _roots(squared)
            radius[rows[closer]] = away[closer]
            for child, ranges in ((tree.inner[at], tree.inner_range[at]), (tree.outer[at], tree.outer_range[at])):
                if child >= 0:
                    gap = np.maximum(away - ranges[1], ranges[0] - away) - _MARGIN * (away + ranges[1])
                    bound[rows, child] = np.maximum(under, gap)
    return number, best


def _integers(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), components)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            yield batch.slice(start, _BATCH)


def _scale(components: int, scale: int):
    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(values * float(scale)), -LARGEST, LARGEST).astype(np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * components
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, whole)], names=["vec_id", "q"])

    return integers


def _sums(shared, components: int):
    """Per task and centroid: number of vectors and the sum of each component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        k = len(tree.number)
        counts = np.zeros(k, dtype=np.int64)
        # Python integers: a task's sums never leave their range.
        sums = np.zeros((k, components), dtype=object)
        for batch in _batches(batches):
            x = _integers(batch.column(0), components)
            number, _ = nearest(tree, x)
            for c in np.unique(number):
                part = x[number == c]
                counts[c] += len(part)
                # A batch of at most 2^53 * 2,048 may leave 64 bits, so large ones are added as Python integers.
                part = part if int(np.abs(part).max()) < 1 << 50 else part.astype(object)
                sums[c] += part.sum(axis=0).astype(object)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(filled.astype(np.int32)),
                pa.array(counts[filled]),
                pa.array([[Decimal(int(s)) for s in sums[c]] for c in filled], pa.list_(pa.decimal128(38, 0))),
            ],
            names=["cluster", "n", "sums"],
        )

    return add


def _assign(shared, components: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in _batches(batches):
            number, best = nearest(tree, _integers(batch.column(1), components))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number.astype(np.int32)), pa.array([Decimal(int(d)) for d in best], pa.decimal128(38, 0))],
                names=["vec_id", "cluster", "exact"],
            )

    return assign


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose seeded id has the smallest hash; of rows that repeat an id, the smaller vectors first."""
    hashed = kept.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    chosen = hashed.orderBy("h", "q").limit(k).select("q").collect()
    return np.array([r[0] for r in chosen], dtype=np.int64)


def moved(spark: SparkSession, kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; one without vectors stays where it is."""
    components = centroids.shape[1]
    shared = spark.sparkContext.broadcast(build_tree(centroids))
    parts = kept.select("q").mapInArrow(_sums(shared, components), "cluster int, n bigint, sums array<decimal(38,0)>")
    totals = (
        parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
        .groupBy("cluster", "d")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .collect()
    )
    after = centroids.copy()
    for row in totals:
        after[row.cluster, row.d] = int(row.s) // row.n
    shared.unpersist()
    return after


def centroid_digest(centroid: np.ndarray) -> str:
    """SHA-256 of a centroid's components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    components: int = COMPONENTS,
    seed: str = SEED,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors of another length, null ones and those with null or non-finite
    components are left out. Components become floor(scale * x), at most 2^53 in
    size. Centroids start as the ``k`` kept vectors whose ``seed:vec_id`` has the
    smallest SHA-256 (all, if fewer); rows without vec_id are clustered but
    never start one. Each of ``rounds`` rounds assigns every vector to the nearest
    centroid, ties to the smaller number, and replaces each centroid that has
    vectors by their exact floored mean; then vectors are assigned once more.
    Distances and their sums are exact up to 38 digits; beyond 64 bits they are
    reported as the largest 64-bit integer. Repeated rows count each. Other
    columns are ignored; without any start there are no rows. The driver holds k
    centroids.
    """
    spark = vectors.sparkSession
    values = F.col("vector")
    usable = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(
        (F.size(values) == components) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    kept = keep(usable.mapInArrow(_scale(components, scale), "vec_id bigint, q array<bigint>"), "integers")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        kept, centroids = kept.limit(0), np.zeros((1, components), dtype=np.int64)
    for _ in range(rounds):
        after = moved(spark, kept, centroids)
        if (after == centroids).all():
            break  # A fixed point: further rounds change nothing.
        centroids = after
    shared = spark.sparkContext.broadcast(build_tree(centroids))
    assigned = keep(kept.mapInArrow(_assign(shared, components), "vec_id bigint, cluster int, exact decimal(38,0)"), "assigned")
    most = F.lit(_LONG).cast("decimal(38,0)")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum("exact")).collect()}
    total = min(sum(inertia.values()), _LONG)
    facts = spark.createDataFrame(
        [(c, min(inertia.get(c, 0), _LONG), total, centroid_digest(centroids[c])) for c in range(len(centroids))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(facts, "cluster").select(
        "vec_id", "cluster", F.least("exact", most).cast("bigint").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

A vector's home is the cell of its nearest centre. A partner of cosine >= t lies
within the angle arccos(t), so it can only be at home in a cell whose border
with the vector's own cell is that near; the vector visits exactly these cells.
Comparing the home vectors of each cell with its home and visiting vectors
therefore finds every link once for each end: the cells are an exact filter,
not an approximation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from patchlake.llm.common import components, keep

# Centres are fitted on at most about this many vectors; it bounds their number too.
SAMPLE_VECTORS = 16384
CELL_VECTORS = 2048
MAX_CENTRES = 1024
ROUNDS = 8
# Vectors on either side of one block product.
BLOCK = 1024
SEED = 7
# Slack for rounding in single-precision inputs and unit lengths.
_SLACK = 1e-6


def fit_centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by spherical k-means (numpy, on the bounded sample)."""
    rng = np.random.default_rng(SEED)
    if len(vectors) == 0:
        return np.zeros((0, 0))
    centres = vectors[rng.permutation(len(vectors))[: max(1, k)]].copy()
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1)
        filled = lengths > 1e-12
        centres[filled] = sums[filled] / lengths[filled, None]
    return np.unique(centres, axis=0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
    else:
        flat = np.concatenate([np.asarray(v) for v in column])
    return flat.astype(np.float64).reshape(len(column), -1)


def _cells(shared, threshold: float):
    """Rows of (cell, home) for each vector: its own cell, and those it visits."""
    reach = math.sin(math.acos(min(1.0, threshold))) + _SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        gaps = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 256 else None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = _matrix(part.column(part.schema.names.index("vector")))
                x /= np.linalg.norm(x, axis=1)[:, None]
                near = x @ centres.T
                home = near.argmax(axis=1)
                gap = gaps[home] if gaps is not None else np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
                # Distance of the vector from the plane between its own centre and another one.
                inside = near[np.arange(len(x)), home][:, None] - near <= reach * gap + _SLACK
                inside[np.arange(len(x)), home] = True
                row, cell = np.nonzero(inside)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                    names=[*part.schema.names, "cell", "home"],
                )

    return assign


_LINKS_DDL = "cid bigint, partners bigint, near bigint"


def _tile(threshold: float):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the tile's home block with its other block: weights per home vector, and a spanning forest."""
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"cid": [], "partners": [], "near": []}).astype("int64")
        a, b = _matrix(left["vector"]), _matrix(right["vector"])
        cosine = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        linked = cosine >= threshold
        ids_a, ids_b = left["cid"].to_numpy(), right["cid"].to_numpy()
        linked &= ids_a[:, None] != ids_b[None, :]
        partners = linked @ right["copies"].to_numpy(dtype=np.int64)
        rows, columns = np.nonzero(linked)
        if len(rows) == 0:
            return pd.DataFrame({"cid": [], "partners": [], "near": []}).astype("int64")
        # Smallest id reachable inside the tile, for both sides: a star per group instead of all its pairs.
        label_a, label_b = ids_a.copy(), ids_b.copy()
        while True:
            was = label_a.sum() + label_b.sum(), label_a.copy()
            np.minimum.at(label_b, columns, label_a[rows])
            np.minimum.at(label_a, rows, label_b[columns])
            if (label_a == was[1]).all() and label_a.sum() + label_b.sum() == was[0]:
                break
        some_a, some_b = linked.any(axis=1), linked.any(axis=0)
        return pd.DataFrame(
            {
                "cid": np.concatenate((ids_a[some_a], ids_b[some_b])),
                "partners": np.concatenate((partners[some_a], np.zeros(some_b.sum(), dtype=np.int64))),
                "near": np.concatenate((label_a[some_a], label_b[some_b])),
            }
        )

    return links


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared when their labels are equal and not null and their
    lengths agree, by cosine in double precision. A null, empty or zero vector, one
    with null or non-finite components and one without label links with
    nothing. Equal vectors of a label are one class with a count: copies link with
    each other and share their links, and are never paired out. A group's
    smallest vec_id is kept; of rows that repeat it, exactly one.
    """
    spark = vectors.sparkSession
    vector = F.col(embedding).cast("array<double>")
    good = (
        F.col(label).isNotNull()
        & (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = keep(
        vectors.select(
            F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), vector.alias("vector"),
            F.coalesce(good, F.lit(False)).alias("good"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    # Adding zero turns -0.0 into 0.0.
    usable = rows.where("good").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    classes = keep(
        usable.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    number = classes.count()
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("vector").alias("n")).count().collect()}
    found = None
    for dimension, size in sorted(sizes.items()):
        own = classes.where(F.size("vector") == dimension)
        share = min(1.0, SAMPLE_VECTORS / size)
        spread = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = own.where(spread).select("cid", "vector").limit(2 * SAMPLE_VECTORS).toPandas().sort_values("cid")
        x = _matrix(sample["vector"]) if len(sample) else np.zeros((0, dimension))
        x = x / np.linalg.norm(x, axis=1)[:, None] if len(x) else x
        # Labels share the centres: a cell holds the vectors of one label near one centre.
        centres = fit_centres(x, min(MAX_CENTRES, max(1, math.ceil(size / CELL_VECTORS))))
        if not len(centres):
            centres = np.eye(1, dimension)
        shared = spark.sparkContext.broadcast(centres)
        schema = StructType([*own.schema.fields, StructField("cell", IntegerType()), StructField("home", BooleanType())])
        cells = keep(own.mapInArrow(_cells(shared, threshold), schema), "cells")
        counts = cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("residents"))
        sized = cells.join(counts.where("residents > 0 and members > 1"), ["label", "cell"])
        homes = F.ceil(F.col("residents") / BLOCK).cast("int")
        all_ = F.ceil(F.col("members") / BLOCK).cast("int")
        spot = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "cid"), n).cast("int")
        left = sized.where("home").select(
            "label", "cell", spot(1, homes).alias("i"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("j"),
            F.lit(0).alias("side"), "cid", "copies", "vector",
        )
        right = sized.select(
            "label", "cell", F.explode(F.sequence(F.lit(0), homes - 1)).alias("i"), spot(2, all_).alias("j"),
            F.lit(1).alias("side"), "cid", "copies", "vector",
        )
        tiles = left.unionByName(right).groupBy("label", "cell", "i", "j").applyInPandas(_tile(threshold), _LINKS_DDL)
        found = tiles if found is None else found.unionByName(tiles)
    if found is None:
        found = spark.createDataFrame([], _LINKS_DDL)
    found = keep(found, "links")
    groups = components(found.select(F.col("cid").alias("a"), F.col("near").alias("b")))
    partners = found.groupBy("cid").agg(F.sum("partners").alias("partners"))
    facts = keep(
        classes.select("label", "vector", "cid", "copies")
        .join(partners, "cid", "left")
        .join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .select("label", "vector", "copies", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("component", "cid").alias("component")),
        "facts",
    )
    # Rows of a class: the label and the vector name it.
    members = keep(
        usable.join(facts, ["label", "vector"]).select(
            "row", "vec_id", (F.col("partners") + F.col("copies") - 1).alias("n_links"), "component"
        ),
        "members",
    )
    first = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", "row")
    heads = keep(members.groupBy("component").agg(F.min(first).alias("first")), "heads")
    grouped = members.join(heads, "component").select(
        "vec_id", "n_links", F.col("first.vec_id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("kept")
    )
    alone = rows.where("not good").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return grouped.unionByName(alone)

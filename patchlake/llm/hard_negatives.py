"""Hard-negative mining by Fagin's threshold algorithm.

Candidates lie in blocks of bounded size, each with one sorted list per
dimension. An anchor reads the lists of a block from the end that its own
component makes best (the largest values where it is positive, the smallest
where it is negative), scores every row it meets for the first time by the full
integer inner product, and keeps as threshold the score that a row standing at
the present depth of every list would have. No unseen row can score more, so it
stops once the threshold falls strictly below the kth score of every window, or
below the window's own lower end.

Anchors are a stated query set, so every block of candidates meets every anchor:
a block travels once, the anchors pass by it as narrow rows, and only a window's
best rows of a block go on. What is merged per anchor is a few rows per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.llm.common import keep

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# A negative's score lies between these shares of the positive's, in percent.
LOWEST, HIGHEST = 50, 95
# Candidates of a block: 64 components take 6 MB with their lists.
BLOCK_ROWS = 8192
# Entries read from every list at first; the depth doubles from there.
FIRST_DEPTH = 64
_PART_BITS = 38
# Inner products are exact in doubles below this.
_EXACT = 2.0**53
_LONG = 2**63 - 1
_MOST = 10**38 - 1
# Stands for a missing vec_id: last among equal scores.
_NO_ID = _LONG


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; what would leave their range takes its largest value."""
    largest = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -largest, largest)


def inner(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64 where they fit and else as Python integers."""
    if rows.size == 0:
        return np.zeros(len(rows), dtype=np.int64)
    if float(np.abs(rows).max()) * float(np.abs(anchor).max()) * len(anchor) < _EXACT:
        return (rows @ anchor).astype(np.int64)
    right = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(row, right)) for row in rows] + [None], dtype=object)[:-1]


class Lists:
    """The chosen rows of a block and, per dimension, their order by ascending value."""

    def __init__(self, matrix: np.ndarray, orders: np.ndarray, chosen: np.ndarray):
        self.matrix = matrix
        self.rows = np.flatnonzero(chosen)
        self.size = len(self.rows)
        # Every list holds each row once, so the chosen parts are equally long.
        self.orders = orders[chosen[orders]].reshape(len(orders), self.size)


def best_in_windows(
    lists: Lists, anchor: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, ids: np.ndarray, skip: int = -1
) -> list[list[tuple[int, int]]]:
    """For every window (low, high) its k best rows [(score, row)], ties by ``ids``; None is no bound, ``skip`` is left out."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    used = np.concatenate((up, down))
    unseen = np.zeros(len(lists.matrix), dtype=bool)
    unseen[lists.rows] = True
    if skip >= 0:
        unseen[skip] = False
    size, depth, open_ = lists.size, 0, list(range(len(windows)))
    while open_ and depth < size:
        # A zero anchor has no list to read: all rows score 0 and are met at once.
        reach = min(size, 2 * depth or FIRST_DEPTH) if len(used) else size
        met = np.zeros(len(unseen), dtype=bool)
        if len(used):
            met[lists.orders[up, size - reach : size - depth].ravel()] = True
            met[lists.orders[down, depth:reach].ravel()] = True
        else:
            met[lists.rows] = True
        fresh = np.flatnonzero(met & unseen)
        unseen[fresh] = False
        depth = reach
        scores = inner(lists.matrix[fresh], anchor)
        for w in open_:
            low, high = windows[w]
            fits = np.ones(len(fresh), dtype=bool)
            if low is not None:
                fits &= scores >= low
            if high is not None:
                fits &= scores <= high
            if len(found[w]) >= k:
                fits &= scores >= found[w][k - 1][0]
            elif fits.sum() > k:
                fits &= scores >= np.sort(scores[fits])[-k]
            new = [(int(s), int(r)) for s, r in zip(scores[fits], fresh[fits])]
            found[w] = sorted(found[w] + new, key=lambda e: (-e[0], ids[e[1]], e[1]))[:k]
        if depth < size:
            # Every unseen row stands behind the last entry read, in every list.
            edge = np.concatenate((lists.matrix[lists.orders[up, size - depth], up], lists.matrix[lists.orders[down, depth - 1], down]))
            threshold = inner(edge[None, :], anchor[used])[0]
            open_ = [w for w in open_ if not _settled(found[w], windows[w][0], k, threshold)]
    return found


def _settled(found: list[tuple[int, int]], low: int | None, k: int, threshold: int) -> bool:
    return (len(found) >= k and threshold < found[k - 1][0]) or (low is not None and threshold < low)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()),
        ("labels", pa.list_(pa.string())), ("matrix", pa.binary()), ("orders", pa.binary()),
    ]
)
_BLOCK_DDL = "block bigint, dim int, rows binary, ids binary, labels array<string>, matrix binary, orders binary"


def _pack(block_rows: int, scale: int):
    """Rows of a task, gathered into blocks by vector length; a block goes out when it is full."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _PART_BITS
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows, ids, labels, matrices = zip(*held.pop(dim))
            matrix = np.concatenate(matrices)
            record = {
                "block": number, "dim": dim, "rows": np.concatenate(rows).tobytes(), "ids": np.concatenate(ids).tobytes(),
                "labels": [x for part in labels for x in part], "matrix": matrix.tobytes(),
                "orders": np.argsort(matrix, axis=0, kind="stable").T.astype("<i4").tobytes(),
            }
            number += 1
            return pa.RecordBatch.from_pylist([record], schema=_BLOCK)

        for batch in batches:
            names = batch.schema.names
            dims = batch.column(names.index("vector")).value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = np.flatnonzero(dims == dim)
                while len(of_dim):
                    space = block_rows - sum(len(part[0]) for part in held.get(dim, []))
                    taken, of_dim = batch.take(pa.array(of_dim[:space])), of_dim[space:]
                    row, ids, label, vector = (taken.column(names.index(n)) for n in ("row", "vec_id", "label", "vector"))
                    part = (
                        row.to_numpy().astype("<i8"), ids.fill_null(_NO_ID).to_numpy().astype("<i8"), label.to_pylist(),
                        scaled(_matrix(vector, dim), scale),
                    )
                    held.setdefault(dim, []).append(part)
                    if len(part[0]) == space:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return pack


_FOUND = pa.schema([("anchor_row", pa.int64()), ("window", pa.int32()), ("score", pa.decimal128(38, 0)), ("row", pa.int64()), ("id", pa.int64())])
_FOUND_DDL = "anchor_row bigint, window int, score decimal(38,0), row bigint, id bigint"


def _search(k: int, same_label: bool, lowest: int, highest: int, scale: int):
    """Every block against the anchors behind it: a window's best rows in the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = orders = rows = ids = labels = lists = listed = None
        for batch in batches:
            out: list[tuple] = []
            names = batch.schema.names
            column = lambda name, i: batch.column(names.index(name))[i].as_py()  # noqa: B023, E731
            for i, kind in enumerate(batch.column(names.index("kind")).to_pylist()):
                if kind == 0:
                    rows, ids = (np.frombuffer(column(n, i), dtype="<i8") for n in ("rows", "ids"))
                    dim = column("dim", i)
                    matrix = np.frombuffer(column("matrix", i), dtype="<f8").reshape(len(rows), dim)
                    orders = np.frombuffer(column("orders", i), dtype="<i4").reshape(dim, len(rows))
                    labels, lists = np.array([*column("labels", i), None], dtype=object)[:-1], None
                    continue
                label, anchor_row = column("label", i), column("row", i)
                if lists is None or label != listed:
                    lists, listed = Lists(matrix, orders, (labels == label) == same_label), label
                anchor = scaled(np.array(column("vector", i), dtype=np.float64), scale)
                if same_label:
                    windows, skip = [(None, None)], np.flatnonzero(rows == anchor_row)
                    skip = int(skip[0]) if len(skip) else -1
                else:
                    scores, skip = [int(s) for s in column("scores", i)], -1
                    windows = [(-(-s * lowest // 100), s * highest // 100) for s in scores]
                for w, best in enumerate(best_in_windows(lists, anchor, windows, k, ids, skip)):
                    out += [(anchor_row, w, Decimal(max(-_MOST, min(_MOST, s))), int(rows[r]), int(ids[r])) for s, r in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    return search


def _met(blocks: DataFrame, anchors: DataFrame, search) -> DataFrame:
    """Candidate blocks, each with all anchors of its vector length behind it, searched where they meet."""
    homes = blocks.select("dim", F.col("block").alias("home"))
    first = blocks.select(F.col("block").alias("home"), F.lit(0).alias("kind"), *blocks.columns)
    behind = anchors.join(homes, "dim").select("home", F.lit(1).alias("kind"), *anchors.columns)
    met = first.unionByName(behind, allowMissingColumns=True).repartition(max(1, blocks.count()), "home")
    return met.sortWithinPartitions("home", "kind", "label").mapInArrow(search, _FOUND_DDL)


def _first(found: DataFrame, keys: list[str], k: int, place: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def _long(score: str) -> Column:
    most = F.lit(_LONG).cast("decimal(38,0)")
    return F.greatest(F.least(F.col(score), most), -most).cast("bigint")


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says whether a row is an anchor, ``label`` gives its label. Rows
    without label or vector, or with a null or non-finite component, take no
    part. A row's score is the inner product of both vectors after
    floor(scale * x); higher scores come first, then smaller vec_ids, rows
    without one last. An anchor's positives are its first rows of the same label,
    itself left out; each has as negatives the first rows of other labels whose
    score is ``lowest`` to ``highest`` percent of its own. Only vectors of the
    same length meet. Rows that repeat a vec_id are rows of their own. Scores are
    compared exactly up to 38 digits; one beyond 64 bits is reported as the
    nearest 64-bit integer. Other columns are ignored; an empty table gives no rows.
    """
    rows = keep(
        vectors.select(
            F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("string").alias("label"),
            F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        )
        .where(F.col("label").isNotNull() & F.col("vector").isNotNull())
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumn("row", F.monotonically_increasing_id()),
        "candidates",
    )
    blocks = keep(rows.select("row", "vec_id", "label", "vector").mapInArrow(_pack(block_rows, scale), _BLOCK_DDL), "blocks")
    anchors = rows.where("is_anchor").select("row", "label", "vector", F.size("vector").alias("dim"))
    found = _met(blocks, anchors, _search(positives, True, lowest, highest, scale))
    best = keep(_first(found, ["anchor_row"], positives, "place"), "positives")
    placed = F.array_sort(F.collect_list(F.struct("place", "score")))
    scores = best.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(placed, lambda p: p.score).alias("scores"))
    windowed = keep(anchors.join(scores, "row"), "anchors")
    found = _met(blocks, windowed, _search(negatives, False, lowest, highest, scale))
    chosen = keep(_first(found, ["anchor_row", "window"], negatives, "rank"), "negatives")
    known = F.when(F.col("id") != _NO_ID, F.col("id"))
    left = best.select("anchor_row", (F.col("place") - 1).alias("window"), known.alias("positive_id"), _long("score").alias("positive_score"))
    right = chosen.select("anchor_row", "window", "rank", known.alias("negative_id"), _long("score").alias("negative_score"))
    ids = rows.where("is_anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        right.join(left, ["anchor_row", "window"])
        .join(ids, "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )

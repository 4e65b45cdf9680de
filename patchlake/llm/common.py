"""What the operators share: tables, stored steps, connected components, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.session import scratch_path

WHITE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The copy outlives lost executors, fixes row ids made on the way, and has no
    partitioning of its own: a join of two such tables shuffles both sides, so
    that the adaptive skew join can split a hot key.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`keep` when everything that reads them is stored itself."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.kept_path)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut into short ones, so that long texts do not pile up as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a, b).

    Every node hooks to its smallest neighbour, chains are halved until each
    node points at a root, and edges are contracted to roots; this repeats until
    no edge is left. Minima combine before the shuffle and all joins are between
    stored tables, so a node with a third of all edges is split. Only nodes with
    an edge are returned; null ends and loops are ignored. The driver sees one
    number per step.
    """
    live = keep(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    total = None
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(live.select("b", "a"))
        parent = keep(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        while True:
            above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = keep(
                parent.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")),
                "parents",
            )
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            root = parent.select(F.col("u").alias("component"), "p")
            total = keep(
                total.join(root, "component", "left").select("node", F.coalesce("p", "component").alias("component")),
                "components",
            )
        left = parent.select(F.col("u").alias("a"), F.col("p").alias("ra"))
        right = parent.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        half = keep(live.join(left, "a").select("ra", "b"), "edges")
        live = keep(
            half.join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if total is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return total


_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, BASE, dtype=np.uint64))))
                self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, BASE_INVERSE, dtype=np.uint64))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of code[j] * base^j over j < i, modulo 2^64."""
    up, _ = POWERS.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[codes] * up[: len(codes)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))

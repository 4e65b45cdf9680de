"""Line dedup: repeated lines are found in a sharded minimal perfect hash, not by joining lines.

Every long line is named by a 128-bit hash of its key. One aggregate counts the
documents of each name; names of at least ``min_documents`` documents are the
keys of the index. They are dealt over shards of bounded size by their hash,
and each shard is a minimal perfect hash (levels of bit arrays; a key's slot is
the rank of its bit) over three arrays by slot: fingerprint, number of
documents and the largest doc_id.

Documents send the hashes of their lines, never the lines, to the shards. A
task holds the arrays of one shard at a time and probes them batch by batch; the
fingerprint turns away hashes that were never indexed. A shard that a hot line
floods is handed out several times, each copy to a part of the documents. Only
hits come back, as places in a document's own list of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patchlake.llm.common import discard, keep, mix, slices

MIN_CODE_POINTS = 40
MIN_DOCUMENTS = 5
# Keys of a shard, on average: its arrays take about 1.5 MB.
SHARD_KEYS = 1 << 16
# Probes that one copy of a shard answers, about.
COPY_PROBES = 1 << 18
# Copies share tasks beyond this number of tasks or the session's own, whichever is larger.
PROBE_TASKS = 4096
# Bits of a level for each key that is left, and a step of the level's seed.
_BITS_PER_KEY = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_PART_BITS = 38


def line_key(line: bytes) -> bytes:
    """A UTF-8 line without white space at its ends, A-Z in lower case."""
    return line.strip(_WHITE).lower()


def key_of(line: bytes, min_code_points: int) -> bytes | None:
    """The key of a line that is long enough, else None."""
    key = line_key(line)
    if len(key) < min_code_points:
        return None
    if not key.isascii() and len(key.translate(None, _CONTINUATION)) < min_code_points:
        return None
    return key


def document_keys(lines: list[bytes], min_code_points: int) -> dict[bytes, int]:
    """The distinct keys of a document's long lines, numbered by first occurrence."""
    keys: dict[bytes, int] = {}
    for line in lines:
        key = key_of(line, min_code_points)
        if key is not None:
            keys.setdefault(key, len(keys))
    return keys


_PREPARED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("text", pa.binary()),
        ("n_lines", pa.int64()),
        ("spots", pa.list_(pa.int64())),
        ("prints", pa.list_(pa.int64())),
    ]
)
_PREPARED_DDL = "row bigint, doc_id bigint, text binary, n_lines bigint, spots array<bigint>, prints array<bigint>"


def _prepare(min_code_points: int):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << _PART_BITS
        for batch in slices(batches, 64):
            rows, counts, spots, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                lines = (text or b"").split(b"\n")
                digests = b"".join(xxhash.xxh3_128_digest(k) for k in document_keys(lines, min_code_points))
                both = np.frombuffer(digests, dtype="<i8")
                spots.append(both[0::2])
                prints.append(both[1::2])
                counts.append(len(lines))
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(spots, pa.list_(pa.int64())),
                    pa.array(prints, pa.list_(pa.int64())),
                ],
                schema=_PREPARED,
            )

    return prepare


def _places(spots: np.ndarray, prints: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A bit of a level for every (spot, fingerprint)."""
    with np.errstate(over="ignore"):
        seed = _STEP * np.uint64(2 * level + 1)
        return mix(spots ^ mix(prints * seed + seed)) % np.uint64(bits)


class PerfectHash:
    """A minimal perfect hash over distinct (spot, fingerprint) pairs of 64 bits each.

    A key that is alone at its bit of a level is placed there, the others go on
    to the next level. Slots are the ranks of the set bits, so n keys have slots 0
    to n - 1.
    """

    def __init__(self, levels: list[int], packed: bytes):
        self.levels = levels
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=sum(levels), bitorder="little")
        self.bits = bits.astype(bool)
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, spots: np.ndarray, prints: np.ndarray) -> PerfectHash:
        levels, layers, left = [], [], np.arange(len(spots))
        while len(left):
            size = max(8, _BITS_PER_KEY * len(left))
            place = _places(spots[left], prints[left], len(levels), size).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            layers.append(alone)
            left = left[~alone[place]]
        bits = np.concatenate(layers) if layers else np.zeros(0, dtype=bool)
        return cls(levels, np.packbits(bits, bitorder="little").tobytes())

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def slots(self, spots: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The slot of every key; of a key that was never placed some slot or -1."""
        found = np.full(len(spots), -1, dtype=np.int64)
        open_, base = np.arange(len(spots)), 0
        for level, size in enumerate(self.levels):
            if not len(open_):
                break
            place = base + _places(spots[open_], prints[open_], level, size).astype(np.int64)
            hit = self.bits[place]
            found[open_[hit]] = self.ranks[place[hit]]
            open_ = open_[~hit]
            base += size
        return found


_SHARD_DDL = "shard bigint, levels array<bigint>, bits binary, fingerprints binary, counts binary, keepers binary, probes bigint"


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    """One shard's perfect hash with its arrays in slot order."""
    spots = group["spot"].to_numpy(dtype=np.int64).view(np.uint64)
    prints = group["print"].to_numpy(dtype=np.int64).view(np.uint64)
    table = PerfectHash.build(spots, prints)
    order = np.empty(len(group), dtype=np.int64)
    order[table.slots(spots, prints)] = np.arange(len(group))
    counts = group["documents"].to_numpy(dtype=np.int64)
    return pd.DataFrame(
        {
            "shard": [int(group["shard"].iloc[0])],
            "levels": [table.levels],
            "bits": [table.packed()],
            "fingerprints": [prints[order].astype("<u8").tobytes()],
            "counts": [counts[order].astype("<i8").tobytes()],
            "keepers": [group["keeper"].to_numpy(dtype=np.int64)[order].astype("<i8").tobytes()],
            "probes": [int(counts.sum())],
        }
    )


def line_index(prepared: DataFrame, min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The index over repeated lines, one row per shard, and the number of shards.

    ``prepared`` names every distinct line of a document once. A line that all
    its documents may keep (none of them has a doc_id) needs no entry.
    """
    counted = (
        prepared.select("doc_id", F.explode(F.arrays_zip("spots", "prints")).alias("key"))
        .groupBy(F.col("key.spots").alias("spot"), F.col("key.prints").alias("print"))
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
    )
    repeated = keep(counted.where((F.col("documents") >= min_documents) & F.col("keeper").isNotNull()), "repeated")
    shards = max(1, -(-repeated.count() // shard_keys))
    index = repeated.withColumn("shard", F.pmod("spot", F.lit(shards))).groupBy("shard").applyInPandas(_shard, _SHARD_DDL)
    kept = keep(index, "shards")
    discard(repeated)
    return kept, shards


_HITS = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("documents", pa.int64())])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of a sorted run of probes, each shard's arrays in front of its probes."""
    table, fingerprints, counts, keepers = None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        column = lambda name: batch.column(names.index(name))  # noqa: B023, E731
        kinds = column("kind").to_numpy()
        shards = column("shard").to_numpy()
        starts = np.flatnonzero((kinds == 0) | np.concatenate(([True], shards[1:] != shards[:-1])))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            if kinds[start] == 0:
                table = PerfectHash(column("levels")[start].as_py(), column("bits")[start].as_py())
                fingerprints = np.frombuffer(column("fingerprints")[start].as_py(), dtype="<u8")
                counts = np.frombuffer(column("counts")[start].as_py(), dtype="<i8")
                keepers = np.frombuffer(column("keepers")[start].as_py(), dtype="<i8")
                start += 1
            if start == end:
                continue
            part = slice(start, end)
            spots = column("spot").to_numpy()[part].view(np.uint64)
            prints = column("print").to_numpy()[part].view(np.uint64)
            slot = table.slots(spots, prints)
            hit = (slot >= 0) & (fingerprints[slot] == prints)
            # A missing doc_id is never the largest one.
            known = column("has_id").to_numpy(zero_copy_only=False)[part]
            own = column("doc_id").to_numpy()[part]
            hit &= ~(known & (own == keepers[slot]))
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column("row").to_numpy()[part][hit]),
                        pa.array(column("k").to_numpy()[part][hit].astype(np.int32)),
                        pa.array(counts[slot[hit]]),
                    ],
                    schema=_HITS,
                )


def probe(prepared: DataFrame, index: DataFrame, shards: int, copy_probes: int = COPY_PROBES) -> DataFrame:
    """(row, k, documents): the lines that a document loses, by their number in its list of keys."""
    lines = prepared.agg(F.sum(F.size("spots"))).first()[0] or 0
    # Lines of the shard's own keys, and its even share of those that are no key.
    load = F.col("probes") + F.lit(lines // shards)
    sized = index.select("shard", (F.floor(load / F.lit(copy_probes)) + 1).cast("int").alias("copies"))
    copies = sized.agg(F.sum("copies")).first()[0] or 1
    tasks = min(copies, max(PROBE_TASKS, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    zipped = F.posexplode(F.arrays_zip("spots", "prints")).alias("k", "key")
    probes = (
        prepared.select("row", "doc_id", zipped)
        .select("row", "doc_id", "k", F.col("key.spots").alias("spot"), F.col("key.prints").alias("print"))
        .withColumn("shard", F.pmod("spot", F.lit(shards)))
        .join(sized, "shard")
        .select(
            "shard", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "row", "k", "spot",
            "print", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"),
        )
    )
    arrays = ["levels", "bits", "fingerprints", "counts", "keepers"]
    handed = index.join(sized, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("row"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("spot"),
        F.lit(0).cast("bigint").alias("print"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(False).alias("has_id"), *arrays,
    )
    both = handed.unionByName(probes, allowMissingColumns=True)
    runs = both.repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return runs.mapInArrow(_probe, "row bigint, k int, documents bigint")


def _rewrite(min_code_points: int, with_text: bool):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            names = batch.schema.names
            texts, gone = (batch.column(names.index(n)).to_pylist() for n in ("text", "gone"))
            dropped, digests, left = [], [], []
            for text, numbers in zip(texts, gone):
                text = text or b""
                n = 0
                if numbers:
                    lines = text.split(b"\n")
                    keys, lost = document_keys(lines, min_code_points), set(numbers)
                    stay = [line for line in lines if keys.get(line_key(line), -1) not in lost]
                    n = len(lines) - len(stay)
                    text = b"\n".join(stay)
                dropped.append(n)
                digests.append(hashlib.sha256(text).hexdigest())
                left.append(text.decode("utf-8", "replace") if with_text else None)
            arrays = [
                batch.column(names.index("doc_id")),
                batch.column(names.index("n_lines")),
                pa.array(dropped, pa.int64()),
                pa.array(digests, pa.string()),
                batch.column(names.index("n_most")),
            ]
            labels = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "n_most"]
            if with_text:
                arrays.append(pa.array(left, pa.string()))
                labels.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return rewrite


def drop_repeated_lines(
    docs: DataFrame,
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
    doc_id: str = "doc_id",
    text: str = "text",
    with_text: bool = True,
    shard_keys: int = SHARD_KEYS,
    copy_probes: int = COPY_PROBES,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, n_most[, kept_text]), one row per document.

    A text is split at line feeds; null or empty is one empty line. A line whose
    key (stripped of ASCII white space, A-Z lower-cased) has at least
    ``min_code_points`` and stands in at least ``min_documents`` rows goes, all its
    occurrences, from every row but those of the largest doc_id that holds it. A
    null doc_id is below all others; if no holder has one, the line stays. Rows
    that repeat a doc_id count one each and keep or lose a line together.
    ``n_most`` is the largest number of documents of a dropped line, 0 if none.
    Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    prepared = keep(source.mapInArrow(_prepare(min_code_points), _PREPARED_DDL), "lines", "zstd")
    index, shards = line_index(prepared, min_documents, shard_keys)
    hits = probe(prepared, index, shards, copy_probes).groupBy("row").agg(
        F.collect_list("k").alias("gone"), F.max("documents").alias("n_most")
    )
    hits = keep(hits, "hits")
    # Hits grow with the texts, so they are never broadcast: the plan is the same at every size.
    joined = prepared.select("row", "doc_id", "text", "n_lines").join(hits.hint("merge"), "row", "left").select(
        "doc_id", "text", "n_lines", "gone", F.coalesce("n_most", F.lit(0)).cast("bigint").alias("n_most")
    )
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, n_most bigint"
    out = StructType.fromDDL(schema)
    if with_text:
        out = StructType([*out.fields, StructField("kept_text", StringType())])
    return joined.mapInArrow(_rewrite(min_code_points, with_text), out)

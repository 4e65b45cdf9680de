"""Exact dedup by deterministic block naming.

Every text is cut into blocks of fixed size. Equal blocks get one integer name
(sorted by block, named by their first occurrence), adjacent pairs of names are
named again, and so on until each document has a single name. Names stand for
contents one to one, so no two different texts can meet: there is no hash in
the identity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake.llm.common import WHITE, discard, keep, slices

BLOCK_BYTES = 4096
# A task names its own repeats with a table of at most this many bytes of blocks, then starts a new one.
LOCAL_TABLE_BYTES = 32 << 20
_PART_BITS = 38

_BLOCKS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("pos", pa.int32()),
        ("n_blocks", pa.int32()),
        ("rep", pa.int64()),
        ("occ", pa.int64()),
        ("block", pa.binary()),
        ("text_sha256", pa.string()),
    ]
)
_BLOCKS_DDL = (
    "row bigint, doc_id bigint, pos int, n_blocks int, rep bigint, occ bigint, block binary, text_sha256 string"
)


def normalised(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " ")


def _normalised_bytes(text: bytes | None) -> bytes:
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    lead = b" " if text[:1].isspace() else b""
    trail = b" " if text[-1:].isspace() else b""
    return lead + b" ".join(words) + trail


def _cut(block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _PART_BITS
        occ = row = held = 0
        first: dict[bytes, int] = {}
        for batch in slices(batches):
            out: list[tuple] = []
            rows = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = _normalised_bytes(text)
                n = max(1, -(-len(text) // block_bytes))
                digest = hashlib.sha256(text).hexdigest()
                at = rows[i] if rows else base + row
                for pos in range(n):
                    block = text[pos * block_bytes : (pos + 1) * block_bytes]
                    rep = first.get(block)
                    new = rep is None
                    if new:
                        if held > LOCAL_TABLE_BYTES:
                            first.clear()
                            held = 0
                        rep = first[block] = base + occ
                        held += len(block) + 64
                    out.append(
                        (at, doc_id, pos, n, rep, base + occ, block if new else None, digest if pos == 0 else None)
                    )
                    occ += 1
                row += 1
            if out:
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), _BLOCKS)]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)

    return cut


def identities(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, row: str | None = None
) -> DataFrame:
    """(row, doc_id, text_sha256, n_blocks, name): one collision-free identity (n_blocks, name) per input row.

    ``row`` names a column that numbers the rows; without it they are numbered here.
    The text crosses the network once, each distinct block of a task's table
    once. A block that a third of all rows hold reaches its namer as one row
    per such table; everything after that is narrow integers.
    """
    numbers = [F.col(row).cast("bigint").alias("row")] if row else []
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"), *numbers)
    blocks = keep(source.mapInArrow(_cut(block_bytes), _BLOCKS_DDL), "blocks")
    by_block = Window.partitionBy("block")
    names = blocks.where("block is not null").select("rep", F.min("occ").over(by_block).alias("name"))
    heads = keep(blocks.where("pos = 0").select("row", "doc_id", "text_sha256"), "heads")
    level = keep(blocks.select("row", "pos", "n_blocks", "rep", "occ").join(names, "rep").drop("rep"), "names")
    discard(blocks)
    left = level.agg(F.max("n_blocks")).first()[0] or 1
    finished = [level.where("n_blocks = 1")]
    level, width = level.where("n_blocks > 1"), 1
    while left > 1:
        even = F.col("pos") % 2 == 0
        pairs = keep(
            level.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), "n_blocks").agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                F.min("occ").alias("occ"),
            ),
            "pairs",
        )
        named = keep(pairs.groupBy("a", "b").agg(F.min("occ").alias("name")), "names")
        both = keep(pairs.join(named, ["a", "b"]).select("row", "pos", "n_blocks", "occ", "name"), "names")
        width *= 2
        left = -(-left // 2)
        finished.append(both.where(F.col("n_blocks") <= width))
        level = both.where(F.col("n_blocks") > width)
    ids = finished[0]
    for more in finished[1:]:
        ids = ids.unionByName(more)
    return heads.join(ids.select("row", "n_blocks", "name"), "row")


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, row: str | None = None
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row, dropped ones too.

    Texts are equal when identical after each run of ASCII white space became
    one space. Null counts as empty. Of equal texts the row with the smallest
    doc_id stays; of rows that repeat that doc_id as well, exactly one. A null
    doc_id comes after all others. Other columns are ignored. With a ``row``
    column, which numbers the rows, the result has it as well, as ``row``.
    """
    ids = keep(identities(docs, doc_id, text, block_bytes, row), "identities")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = keep(
        ids.groupBy("n_blocks", "name").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "text_sha256",
        *(["row"] if row else []),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies, all its columns kept; rows that repeat a doc_id and text leave one.

    The rows are numbered and stored once; their identities decide, and the
    numbers of those that stay drop the others in one join.
    """
    numbered = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", "zstd")
    stay = keep(exact_dedup(numbered, doc_id, text, row="__row").where("kept").select(F.col("row").alias("__row")), "stay")
    # What stays grows with the input, so it is never broadcast.
    return numbered.join(stay.hint("merge"), "__row", "left_semi").drop("__row")
